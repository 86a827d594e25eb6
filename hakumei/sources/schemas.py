"""Schemas of files and tables."""

DOCUMENT = (
    "doc_id string, text string, spans array<struct<start int, end int, label string, text string, score double, source string>>, "
    "subset string, genre string, source_license string, source_ref string, negative_kinds array<string>, meta map<string,string>"
)
CORPUS_ITEM = "text string, license string, source string, genre string, attribution string, item_id string, normalized boolean"
PREDICTION = "run_name string, doc_id string, split string, start_pos int, end_pos int, label string, text string, score double, source string"
MASK_MAP = "version string, doc_id string, entries array<struct<placeholder string, original string, label string, start int, end int>>"
