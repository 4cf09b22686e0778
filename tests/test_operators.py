import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from scholarium.operators import documents, graph, layout, matching, papers, responses, reviews, search
from scholarium.plans import catalog
from scholarium.sources import tables

PAPER = "pos long, title string, venue string, citations int, doi string"


def test_dedupe_keeps_the_best_at_the_first_place(spark):
    rows = [(0, "A B", "figshare", 0, "10.1/x.s001"), (1, "C", "J", 1, "10.1/c"), (2, "a-b", "Nature", 5, "10.1/n"), (3, "聚", "J", 0, ""), (4, "硼", "J", 0, ""), (5, "c", "J", 1, "10.1/longer")]
    got = sorted(tuple(r) for r in papers.dedupe_best(spark.createDataFrame(rows, PAPER)).collect())
    assert got == [(0, "a-b", "Nature", 5, "10.1/n"), rows[1], rows[3], rows[4]]
    again = papers.dedupe_best(spark.createDataFrame(got, PAPER))
    assert sorted(tuple(r) for r in again.collect()) == got


def test_supplements(spark):
    rows = [(0, "t", "Nature", 3, "10.1/x.S001"), (1, "t", "Zenodo", 0, "10.1/z"), (2, "t", "zenodo", 4, "10.1/z"), (3, "t", None, None, None)]
    assert [r.pos for r in papers.without_supplements(spark.createDataFrame(rows, PAPER)).orderBy("pos").collect()] == [2, 3]


def test_exact_match(spark):
    library = spark.createDataFrame([("10.1/A", "Known work"), ("", "")], "doi string, title string")
    asked = spark.createDataFrame([(0, " 10.1/a ", "x"), (1, "", "known-WORK"), (2, "", ""), (3, "10.9/none", "Byzantine coins")], "pos int, doi string, title string")
    assert [r.status for r in matching.exact_match(asked, library).orderBy("pos").collect()] == ["have", "have", "new", "new"]


def test_nearest_in_blocks_is_exact(spark):
    """Also where all of the n nearest, or some, point away from the candidate."""
    vectors = spark.range(60).select("id", F.when(F.col("id") < 40, F.array(F.lit(1.0), F.col("id") / 40, F.lit(0.1))).otherwise(F.array(F.lit(-1.0), F.col("id") / 90, F.lit(0.0))).alias("vec"))
    asked = vectors.where("id % 3 = 0").select(F.col("id").alias("pos"), "vec")
    rows = lambda most: sorted(tuple(r) for r in matching.nearest(asked, vectors, 45, most).select("pos", "rank", "id", "sim").collect())
    scan = rows(20_000)
    assert len(scan) == 20 * 45 and min(r[3] for r in scan) < 0
    assert rows(7) == rows(0) == scan
    plan = matching.nearest(asked, vectors, 3, 7)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_snowball(spark):
    works = spark.createDataFrame([(i, f"10.1/{i}", f"t{i}", i) for i in range(1, 6)], "id long, doi string, title string, citations long")
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (4, 1, 0), (5, 1, 0), (5, 2, 1)], "citing long, cited long, ord int")
    seeds = spark.createDataFrame([(0, "10.1/1"), (1, "10.1/2"), (2, "10.1/none")], "seed_pos long, doi string")
    items, stats = graph.expand(seeds, edges, works)
    assert sorted((r.seed_pos, r["from"], r.id) for r in items.collect()) == [(0, "backward", 2), (0, "backward", 3), (0, "forward", 4), (0, "forward", 5), (1, "forward", 1)]
    assert [(r.n_backward, r.n_forward, r.note) for r in stats.orderBy("seed_pos").collect()] == [(2, 2, "t1"), (0, 1, "t2"), (0, 0, "not found")]
    with pytest.raises(ValueError):
        graph.relations(edges, "WRONG", 1, 10)


def greedy(text, most):
    out, cur = [], ""
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if len(cur) + len(p) < most:
            cur = f"{cur}\n{p}" if cur else p
            continue
        out += [cur] if cur else []
        cut = [p[i : i + most] for i in range(0, len(p), most)] if len(p) > most else []
        out, cur = out + cut, "" if cut else p
    return out + ([cur] if cur else [])


def test_chunks_equal_a_greedy_packing(spark):
    texts = ["", "a", "\n\n".join("x" * n for n in (10, 50, 60, 250, 5, 99, 100)), ("段落。" * 100 + "\n\n") * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.c for r in rows.select("doc_id", documents.chunks(F.col("text"), 100).alias("c")).collect()}
    assert got == {i: greedy(t, 100) for i, t in enumerate(texts)}


def test_references_are_cut(spark):
    strip = lambda t: spark.range(1).select(documents.strip_references(F.lit(t)).alias("x")).first().x
    assert strip("A sentence. " * 20 + "\n# References\n[1] tail") == ("A sentence. " * 20).strip()
    assert strip("x\n# References\n" + "long tail " * 20).endswith("long tail ")


def test_paragraph_classes(spark):
    text = "\n\n".join(["Mw = 4200 purchased", "Figures S1-S23", "## Synthesis", "1.19 mmol were added", "TGA: measured on an analyzer", "Plain words", "References", "Kresse, G. 3 h"])
    rows = documents.classify(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [r.kind for r in rows.orderBy("pos").collect()] == ["keep", "drop", "core", "core", "brief", "keep", "drop", "drop"]
    out = documents.filtered_text(rows).first().text
    assert out.endswith("## Characterization methods (condensed)\nTGA") and "Kresse" not in out


REVIEW = "key string, pos long, verdict string, reasons array<string>, snapshot struct<chars:int,figures:int,numbers:int,sections:int>, rated_at string"


def test_reviews(spark):
    rows = spark.createDataFrame([("a", 0, "good", ["x"], None, "1"), ("b", 1, "bad", ["y", "x"], None, "1"), ("a", 2, "bad", [], None, "2")], REVIEW)
    stats = reviews.review_stats(rows).first()
    assert (stats.total, stats.good, stats.bad, stats.ready, stats.chars_good) == (3, 0, 0, False, None)
    assert [(r.reason, r.n) for r in reviews.reason_counts(rows).collect()] == [("x", 2), ("y", 1)]
    assert sorted((r.key, r.verdict) for r in reviews.latest(rows).collect()) == [("a", "bad"), ("b", "bad")]
    read = spark.createDataFrame([("a",), ("z",)], "key string")
    assert [r.key for r in reviews.pending(read, rows).collect()] == ["z"]
    with pytest.raises(ValueError):
        reviews.check_verdict("maybe")


def test_figure_groups(spark):
    block = lambda n, y0, y1, w=200.0: ("d", 0, 600.0, 1000.0, n, "image", 0.0, float(y0), w, float(y1), "")
    rows = [block(0, 0, 100), block(1, 110, 200), block(2, 500, 600), block(3, 610, 620, 20.0), block(4, 800, 900), ("d", 0, 600.0, 1000.0, 5, "text", 0.0, 0.0, 1.0, 1.0, "Fig. 1 caption")]
    got = layout.figure_boxes(spark.createDataFrame(rows, "doc string, page_idx int, page_w double, page_h double, ord int, type string, x0 double, y0 double, x1 double, y1 double, text string")).orderBy("num").collect()
    assert [(r.y0, r.y1, r.caption) for r in got] == [(0.0, 200.0, "Fig. 1 caption"), (500.0, 600.0, ""), (800.0, 900.0, "")]


def test_best_attachment(spark):
    rows = [("i", 0, "k/a_supp.pdf", "k", "x", 900), ("i", 1, "k/b.pdf", "k", "Full Text PDF", 10), ("i", 2, "k/c.pdf", "k", "x", 50), ("j", 0, "k/si.pdf", "k", "SI", 5)]
    got = layout.best_attachment(spark.createDataFrame(rows, "item string, pos int, path string, att_key string, title string, size long"))
    assert {r.item: r.path for r in got.collect()} == {"i": "k/b.pdf", "j": "k/si.pdf"}


def test_answers(spark):
    rows = spark.createDataFrame([(1, "1. shear thickening gel\n- borosiloxane creep\n\n聚硼\nabc\nShear Thickening gel")], "id int, text string")
    assert [r.line for r in responses.clean_lines(rows, 5).orderBy("pos").collect()] == ["shear thickening gel", "borosiloxane creep"]
    raw = json.dumps({"chart_type": "line", "series": [{"name": "s", "points": [[1, 2], [3, 4]]}]})
    got = responses.chart_points(spark.createDataFrame([(1, f"```json\n{raw}\n```"), (2, "no")], "id int, raw string")).orderBy("id", "n").collect()
    assert [(r.id, r.x, r.y, r.error) for r in got] == [(1, 1.0, 2.0, None), (1, 3.0, 4.0, None), (2, None, None, "not JSON")]


def test_sources(spark, tmp_path):
    (tmp_path / "store.json").write_text("{}")
    assert tables.reviews(spark, str(tmp_path / "store.json")).count() == 0
    work = {"id": "https://w.example.org/W123", "doi": "https://doi.org/10.1/x", "title": " T ", "publication_year": 2024, "cited_by_count": 7, "primary_location": {"source": {"display_name": "Nature"}, "is_oa": True}}
    (tmp_path / "works.json").write_text(json.dumps(work))
    paper = tables.work_papers(tables.works(spark, str(tmp_path / "works.json"))).first()
    assert (paper.title, paper.doi, paper.venue, paper.citations, paper.openalex_id, paper.unique_id) == ("T", "10.1/x", "Nature", 7, "W123", "paper:10.1/x")
    (tmp_path / "f" / "key1").mkdir(parents=True)
    (tmp_path / "f" / "key1" / "a.PDF").write_bytes(b"12345")
    assert [(r.att_key, r.size) for r in tables.attachments(spark, str(tmp_path / "f")).collect()] == [("key1", 5)]
    (tmp_path / "f" / "key1" / "full.md").write_text("text\nmore")
    assert [(r.doc_id, r.text) for r in tables.parsed_documents(spark, str(tmp_path / "f")).collect()] == [("key1", "text\nmore")]
    tables.write_table(spark.range(3), str(tmp_path / "t"))
    tables.write_table(spark.range(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_readers_and_sinks(spark, tmp_path):
    hit = {"title": "A\\nB ", "doi": None, "publication_published_year": "2021.0", "citation_count": "12", "is_oa": "True", "author": [{"name": f"a{i}"} for i in range(8)], "doc_id": "d"}
    (tmp_path / "hits.json").write_text(json.dumps(hit))
    paper = tables.hit_papers(tables.hits(spark, str(tmp_path / "hits.json"))).first()
    assert (paper.title, paper.doi, paper.year, paper.citations, paper.is_oa, len(paper.authors), paper.venue) == ("A B", "", 2021, 12, True, 6, "")
    (tmp_path / "evidence.json").write_text(json.dumps({"title": "t", "chunk": "![](x.jpg)text  ", "score": 0.12345, "page_no": 3, "publication_published_year": "2020", "offset": 7, "doc_id": "d"}))
    chunk = tables.evidence(tables.evidence_json(spark, str(tmp_path / "evidence.json"))).first()
    assert (chunk.chunk, chunk.score, chunk.page, chunk.year, chunk.citations, chunk.offset) == ("text", 0.123, 3, 2020, 0, 7)
    store = {"K1": {"verdict": "good", "reasons": ["too_vague"], "note": "n", "title": "t", "snapshot": {"chars": 5, "figures": 1, "numbers": 2, "sections": 3, "size_kb": 4, "mtime": "2024-01-01 10:00"}, "rated_at": "2024-01-02 10:00"}, "K2": {"verdict": "bad", "reasons": [], "snapshot": None}}
    (tmp_path / "store.json").write_text(json.dumps(store))
    got = {r.key: r for r in tables.reviews(spark, str(tmp_path / "store.json")).collect()}
    assert got["K1"].snapshot.size_kb == 4 and got["K1"].reasons == ["too_vague"] and got["K2"].snapshot is None
    (tmp_path / "broken.json").write_text('{"K1": {"verdict":')
    assert tables.reviews(spark, str(tmp_path / "broken.json")).count() == 0
    numbered = spark.range(30).select((30 - F.col("id")).alias("n"), F.lit("x").alias("title")).repartition(3)
    tables.write_results(numbered, str(tmp_path / "out"))
    lines = [json.loads(x)["n"] for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == list(range(1, 31))
    (tmp_path / "page.html").write_text("<style>p{}</style><p>12 nm</p><img src=x>" + "导读" * 500)
    row = reviews.report_snapshots(tables.reports(spark, str(tmp_path / "page.html"))).first().snapshot
    assert (row.numbers, row.figures, row.sections, row.size_kb) == (1, 1, 1, 3) and len(row.mtime) == 16


def test_layout_json(spark, tmp_path):
    span = lambda t: [{"spans": [{"content": t}]}]
    blocks = [{"type": "title", "bbox": [0, 0, 9, 9], "lines": span("Results")}, {"type": "image", "bbox": [10, 100, 400, 300], "blocks": [{"type": "image_body", "bbox": [0, 0, 1, 1], "lines": span("axis")}, {"type": "image_caption", "bbox": [0, 0, 1, 1], "lines": span("Fig. 2 inner")}]}]
    (tmp_path / "layout.json").write_text(json.dumps({"pdf_info": [{"page_idx": 0, "page_size": [600, 800], "para_blocks": blocks}]}))
    flat = layout.flat_blocks(tables.layout_blocks(spark, str(tmp_path / "layout.json")))
    assert [(r.type, r.text, r.caption, r.page_w) for r in flat.orderBy("ord").collect()] == [("title", "Results", None, 600.0), ("image", "axisFig. 2 inner", "Fig. 2 inner", 600.0)]
    assert [(r.caption, r.x0, r.num) for r in layout.figure_boxes(flat).collect()] == [("Fig. 2 inner", 10.0, 1)]


def test_attachments_of_items(spark):
    children = spark.createDataFrame([("i", 0, "K1", "attachment", "application/pdf", "SI"), ("i", 1, "K2", "attachment", "application/pdf", "Full Text PDF"), ("i", 2, "K3", "note", None, ""), ("j", 0, "K4", "attachment", "text/html", "x"), ("j", 1, "K5", "attachment", "application/pdf", "x")], "item string, ord int, att_key string, item_type string, content_type string, title string")
    files = spark.createDataFrame([("s/K1/si.pdf", 900, "K1"), ("s/K2/b.PDF", 10, "K2"), ("s/K2/a.txt", 99, "K2"), ("s/K3/c.pdf", 5, "K3"), ("s/K4/d.pdf", 5, "K4")], "path string, size long, att_key string")
    found = layout.attachment_candidates(children, files)
    assert sorted((r.item, r.pos, r.path) for r in found.collect()) == [("i", 0, "s/K1/si.pdf"), ("i", 1, "s/K2/b.PDF")]
    assert [(r.item, r.path) for r in layout.best_attachment(found).collect()] == [("i", "s/K2/b.PDF")]


def test_discoveries_in_the_library(spark):
    library = spark.createDataFrame([("Known Work", "10.1/A"), ("", " 10.1/b"), (None, None)], "title string, doi string")
    rows = spark.createDataFrame([(0, "known-work", ""), (1, "x", "10.1/a"), (2, "y", "10.1/B"), (3, "", ""), (4, None, None)], "pos int, title string, doi string")
    assert [r.in_library for r in matching.in_library(rows, library).orderBy("pos").collect()] == [True, True, False, False, False]


def test_labels_of_reasons(spark):
    rows = spark.createDataFrame([("a", 0, "bad", ["too_vague", "own"], None, "1")], REVIEW)
    assert [(r.reason, r.label) for r in reviews.reason_counts(rows).collect()] == [("too_vague", reviews.REASONS["too_vague"]), ("own", "own")]


def test_evidence_of_later_years(spark):
    chunks = spark.createDataFrame([("a", 0, "gel creep gel", 2001), ("b", 0, "gel", 2010), ("c", 0, "none", 2012), ("d", 1, "gel gel gel", None)], "doc_id string, n int, chunk string, year int")
    assert [r.doc_id for r in search.ask_evidence(chunks, "gel", 5, 2005).collect()] == ["b"]
    assert {r.doc_id for r in search.ask_evidence(chunks, "gel", 5).collect()} == {"a", "b", "d"}


def test_tfidf_vectors_by_their_definition(spark):
    texts = ["gel creep gel", "gel", "salt water salt", ""]
    rows = search.vectorise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "text", 4096).orderBy("doc_id").collect()
    df = {w: sum(w in t.split() for t in texts) for t in texts for w in t.split()}
    for row, text in zip(rows, texts, strict=True):
        weights = sorted(text.split().count(w) * math.log((len(texts) + 1) / (df[w] + 1)) for w in set(text.split()))
        norm = math.sqrt(sum(w * w for w in weights)) or 1.0
        assert [round(w / norm, 5) for w in weights if w] == [round(v, 5) for v in sorted(v for v in row.vec if v)]


@pytest.mark.parametrize("reverse", [False, True])
def test_figures_of_equal_places_do_not_depend_on_their_order(spark, reverse):
    """Two blocks of one place, far below the one before, and two of one top with different ends."""
    rows = [("a", 1, 0.0, 100.0, 80.0), ("a", 2, 400.0, 100.0, 480.0), ("a", 2, 400.0, 200.0, 480.0), ("b", 1, 0.0, 100.0, 80.0), ("b", 1, 0.0, 100.0, 300.0), ("b", 2, 310.0, 100.0, 390.0)]
    rows = [(doc, 0, 600.0, 1000.0, i, "image", 0.0, y0, x1, y1, "") for doc, i, y0, x1, y1 in rows]
    got = layout.figure_boxes(spark.createDataFrame(rows[:: -1 if reverse else 1], "doc string, page_idx int, page_w double, page_h double, ord int, type string, x0 double, y0 double, x1 double, y1 double, text string").coalesce(1))
    assert sorted((r.doc, r.num, r.y0, r.x1, r.y1) for r in got.collect()) == [("a", 1, 0.0, 100.0, 80.0), ("a", 2, 400.0, 200.0, 480.0), ("b", 1, 0.0, 100.0, 390.0)]


@pytest.mark.parametrize("name", ["figure_boxes", "figure_rectangles", "figure_captions"])
def test_the_sql_of_figures_leaves_no_ties_to_chance(name):
    """The groups are the same whichever of two equal blocks comes first."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT doc AS l_orderkey, n::INT AS l_linenumber, 40.0::DOUBLE AS l_quantity, 'A' AS l_returnflag FROM range(50) AS d(doc), (VALUES (1), (4), (4), (4), (7)) AS v(n)")
    sql = catalog.SQL[name]
    assert sql.count("FROM v)") == 1
    found = [con.execute(sql.replace("FROM v)", f"FROM (SELECT * FROM v ORDER BY doc, y0, apart {order}))")).fetchall() for order in ("ASC", "DESC")]
    assert sorted(found[0]) == sorted(found[1]) and len(found[0]) == 150
