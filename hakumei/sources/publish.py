"""What may be published: rows of documents in their flat form, and file names that stay at home."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import span_to_file

# Names that are never published, fragments of such names, and names that are in spite of a fragment.
FORBIDDEN_NAMES = ("map.json", "mapping.json", ".env", ".netrc", "token", "credentials.json", "secrets.json", "id_rsa", "id_ed25519")
FORBIDDEN_FRAGMENTS = ("secret", "credential", "password", "apikey", "api_key", "private_key", "mapping_table")
ALLOWED_NAMES = ("tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "added_tokens.json", "tokenizer.model")


def sensitive(name: Column) -> Column:
    """Whether a file of this name is withheld; null is."""
    low = F.lower(name)
    fragment = low.contains(FORBIDDEN_FRAGMENTS[0])
    for f in FORBIDDEN_FRAGMENTS[1:]:
        fragment = fragment | low.contains(f)
    withheld = low.isin(*FORBIDDEN_NAMES) | fragment | (low.startswith("map") & low.endswith(".json"))
    return F.coalesce(~low.isin(*ALLOWED_NAMES) & withheld, F.lit(True))


def flat_rows(docs: DataFrame) -> DataFrame:
    """Documents with spans and meta as JSON, meta without the keys that begin with an underscore, no null kinds."""
    rows = docs.withColumn("spans", F.to_json(span_to_file(F.col("spans"))))
    if "meta" in docs.columns:
        rows = rows.withColumn("meta", F.to_json(F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~k.startswith("_"))))
    if "negative_kinds" in docs.columns:
        rows = rows.withColumn("negative_kinds", F.coalesce("negative_kinds", F.array().cast("array<string>")))
    return rows
