"""Schemas of the inputs."""

WORK = "id string, doi string, title string, publication_year int, cited_by_count int, primary_location struct<source:struct<display_name:string>, is_oa:boolean, landing_page_url:string>, open_access struct<is_oa:boolean>, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
HIT = "title string, doi string, publication_published_year string, publication_venue_name_unified string, citation_count string, abstract string, is_oa string, oa_url string, unique_id string, doc_id string, author array<struct<name:string>>, fwci double"
EVIDENCE = "title string, chunk string, score double, page_no int, publication_published_year string, publication_venue_name_unified string, citation_count string, doc_id string, offset long"
REVIEWS = "map<string,struct<verdict:string,reasons:array<string>,note:string,title:string,snapshot:struct<chars:int,figures:int,numbers:int,sections:int,size_kb:int,mtime:string>,rated_at:string>>"
SPAN = "struct<content:string>"
LINE = f"struct<spans:array<{SPAN}>>"
SUB = f"struct<type:string,bbox:array<double>,lines:array<{LINE}>>"
LAYOUT = f"pdf_info array<struct<page_idx:int,page_size:array<double>,para_blocks:array<struct<type:string,bbox:array<double>,blocks:array<{SUB}>,lines:array<{LINE}>>>>>"
CHART = "struct<chart_type:string,x_axis:struct<label:string,unit:string,min:double,max:double,log:boolean>,y_axis:struct<label:string,unit:string,min:double,max:double,log:boolean>,series:array<struct<name:string,points:array<array<double>>>>,confidence:string,note:string>"
SAVED_SEARCH = "query string, time string, items array<struct<n:int,title:string,doi:string,year:int,citations:int,relevance:double,status:string>>"
