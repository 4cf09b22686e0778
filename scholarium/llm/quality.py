"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions.

A small forest on a bounded sample of labelled documents gives conjunctive rules (every path from a root); lasso logistic
regression weighs them and drops most. Scoring takes no Python: statistics, rules and the logistic function are built-in
expressions over each whole text, each computed once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.llm.frames import materialise

#: Labelled documents for the fit at most, taken in the order of a hash of doc_id.
SAMPLE = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002
THRESHOLD = 0.3


#: The numbers about a text that rules may use.
STATISTICS = ["log_chars", "word_chars", "distinct_words", "upper", "digits", "symbols", "doubled_symbols", "bars", "stops", "line_words", "distinct_lines", "bad_characters"]


def _parts(text: Column) -> dict[str, Column]:
    """What several statistics look at: the text, its words and lines, and its symbols with a line end for what is between."""
    t = F.coalesce(text, F.lit(""))
    return {
        "t": t,
        "words": F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "),
        "lines": F.split(t, "\n"),
        "symbols": F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "\n"),
    }


def _statistics(part: Column) -> list[Column]:
    """In the order of STATISTICS."""
    t, words, lines, symbols = (part[k] for k in ("t", "words", "lines", "symbols"))
    n = F.length(t).cast("double")
    n_words = F.when(n > 0, F.size(words)).otherwise(0).cast("double")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    times = lambda c, characters: F.length(c) - F.length(F.translate(c, characters, ""))
    return [
        F.log1p(n),
        per(n, n_words),
        per(F.size(F.array_distinct(words)), n_words),
        per(F.regexp_count(t, F.lit(r"\p{Lu}")), n),
        per(times(t, "0123456789"), n),
        per(F.length(F.translate(symbols, "\n", "")), n),
        per(F.regexp_count(symbols, F.lit(r"([^\n])\1")), n_words),
        per(times(symbols, "|"), n_words),
        per(times(symbols, "."), n_words),
        per(n_words, F.size(lines).cast("double")),
        F.when(n > 0, per(F.size(F.array_distinct(lines)), F.size(lines).cast("double"))).otherwise(0.0),
        per(times(symbols, "\ufffd" + "".join(map(chr, (*range(1, 9), *range(14, 28))))), n),
    ]


def with_statistics(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with a struct `name` of numbers about each whole text, none of them null; all are 0 for null and empty texts.

    The parts, and the statistics, come out of a generator each: Catalyst would else merge the projections and compute
    them anew for whatever uses them.
    """
    parts = docs.withColumn(name, F.explode(F.array(F.struct(*[c.alias(k) for k, c in _parts(F.col(text)).items()]))))
    return parts.withColumn(name, F.explode(F.array(F.struct(*[c.cast("double").alias(k) for k, c in zip(STATISTICS, _statistics(F.col(name)), strict=True)]))))


def _paths(node, names: list[str], path: tuple = ()) -> list[tuple]:
    """Every path from the root to an inner node's child: a conjunction of (name, is above, threshold)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return []
    name, at = names[node.split().featureIndex()], float(node.split().threshold())
    out = []
    for above, child in ((False, node.leftChild()), (True, node.rightChild())):
        longer = path + ((name, above, at),)
        out += [longer, *_paths(child, names, longer)]
    return out


def _holds(rule: tuple, of: Callable[[str], Column]) -> Column:
    return reduce(lambda a, b: a & b, [of(name) > at if above else of(name) <= at for name, above, at in rule])


class RuleModel:
    """Rules with their weights, and the intercept."""

    def __init__(self, rules: list[tuple[tuple, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """docs with `name`, the probability of a good text (0 to 1), in place of a column of that name."""
        known = with_statistics(docs.drop(name), text, name)
        margin = reduce(lambda a, b: a + b, [F.when(_holds(rule, lambda n: F.col(name)[n]), F.lit(w)).otherwise(0.0) for rule, w in self.rules], F.lit(self.intercept))
        return known.withColumn(name, F.explode(F.array(1.0 / (1.0 + F.exp(-margin)))))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels no fit may see."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11) -> RuleModel:
    """Learns labels.quality (0 or 1) from documents that are not held out; conflicting labels of a document go by the
    mean (half counts as good), null ones are ignored. With labels of one kind only, or none, the score is their share."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    names = STATISTICS
    data = materialise(with_statistics(texts, "text", "statistics").select("label", "statistics.*")).coalesce(2)
    counts = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    good, bad = counts.get(1.0, 0), counts.get(0.0, 0)
    constant = RuleModel([], math.log((good + 0.5) / (bad + 0.5)) if good + bad else 0.0)
    if not good or not bad:
        return constant
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(data).select("label", "features", *names).persist()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="0.5").fit(assembled)
    rules = sorted({p for tree in forest.trees for p in _paths(tree._java_obj.rootNode(), names)})
    if not rules:
        return constant
    columns = [f"rule_{i}" for i in range(len(rules))]
    marked = assembled.select("label", *[_holds(r, F.col).cast("double").alias(c) for c, r in zip(columns, rules, strict=True)])
    matrix = VectorAssembler(inputCols=columns, outputCol="features").transform(marked).select("label", "features").persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(matrix)
    for df in (assembled, matrix):
        df.unpersist()
    return RuleModel([(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w], float(lasso.intercept))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): every row of docs is scored on its whole text, null like an empty one.

    Rows without doc_id are left out; repeated rows are scored one by one, very long texts like any. Language, source, ids and labels are no inputs
    of a score. Other columns are ignored.
    """
    model = fit(docs, labels, sample)
    scored = model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
