"""Encoding of the whole corpus with a public tokenizer.

Method: frequent words are compiled with their ids into a minimal acyclic
transducer (lexicon), which every worker maps into memory; all other words are
merged exactly from the rank file. Words are counted over all texts; the lexicon only
decides how fast a word is encoded, never its ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .base import put_file, shared_dir
from .lexicon import Lexicon, compile_lexicon

TOKENIZERS = "/opt/tokenizers"

#: What splits a text into words before any merge. A fixed value of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words in the lexicon, bytes of its longest word, and occurrences a word needs to be in it.
LEXICON_WORDS, WORD_BYTES, WORD_COUNT = 50_000, 48, 2


@cache
def _words() -> regex.Pattern:
    return regex.compile(PATTERN)


@cache
def _merger(path: str):
    """Exact byte-pair merges of one word, by the ranks of the file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda word: encoding.encode_ordinary(word.decode())


@cache
def _lexicon(names: tuple[str, ...]) -> Lexicon:
    return Lexicon.mapped([SparkFiles.get(n) for n in names])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, count) of all words of up to WORD_BYTES bytes in the column text, split and counted in the JVM.

    Blanks beyond ASCII are split otherwise than by the tokenizer, which only makes such words rarer in the lexicon.
    """
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("word"))
    return words.where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.count("*").alias("count"))


def frequent_lexicon(texts: DataFrame, vocabulary: str) -> tuple[str, ...]:
    """Compile the LEXICON_WORDS most frequent words and send the arrays to all workers; names of the files.

    The files go through the shared folder and are named by their contents, so equal lexicons are sent once.
    """
    counts = word_counts(texts).where(F.col("count") >= WORD_COUNT)
    top = counts.orderBy(F.desc("count"), "word").limit(LEXICON_WORDS).collect()  # bounded by LEXICON_WORDS
    merge = _merger(vocabulary)
    words = sorted(r["word"].encode() for r in top)
    spark = texts.sparkSession
    names = []
    for field, data in compile_lexicon(words, [merge(w) for w in words]).files().items():
        name = f"{field}-{hashlib.sha256(data).hexdigest()[:24]}.npy"
        names.append(name)
        path = f"{shared_dir(spark)}/hakumei-lexicon/{name}"
        if (spark.sparkContext.applicationId, path) not in _sent:
            put_file(spark, path, data)
            spark.sparkContext.addFile(path)
            _sent.add((spark.sparkContext.applicationId, path))
    return tuple(names)


#: Files of lexicons that an application has sent to its workers.
_sent: set[tuple[str, str]] = set()


def encoded(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken"
) -> DataFrame:
    """(doc_id, ids) for every row: ids of the text as stored, without special tokens.

    Null and empty texts have an empty array. Repeated rows are encoded each; other
    columns are ignored. The vocabulary is read from `tokenizers`, which every node has.
    """
    path = f"{tokenizers}/{vocabulary}"
    texts = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(text).alias("text"))
    names = frequent_lexicon(texts, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, merge, find = _lexicon(names), _merger(path), _words().findall
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in shingles.slices([len(t) for t in texts]):
                ids = _encode(texts[a:b], lexicon, merge, find)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _encode(texts: list[str], lexicon: Lexicon, merge, find) -> pa.ListArray:
    """Ids of the texts; each distinct word is looked up or merged once."""
    place: dict[str, int] = {}
    sizes = np.zeros(len(texts) + 1, np.int64)
    order: list[int] = []
    for i, text in enumerate(texts, 1):
        words = find(text)
        sizes[i] = len(words)
        order += [place.setdefault(w, len(place)) for w in words]
    distinct = [w.encode() for w in place]
    rank = lexicon.ranks(distinct)
    known = rank >= 0
    start = np.zeros(len(distinct), np.int64)
    length = np.zeros(len(distinct), np.int64)
    start[known] = lexicon.offsets[rank[known]]
    length[known] = lexicon.offsets[rank[known] + 1] - start[known]
    rest = [merge(distinct[i]) for i in np.flatnonzero(~known)]
    merged = np.array([x for own in rest for x in own], np.int32)
    count = np.fromiter(map(len, rest), np.int64, len(rest))
    start[~known] = len(lexicon.ids) + np.cumsum(count) - count
    length[~known] = count
    pool = np.concatenate([lexicon.ids, merged])
    used = np.array(order, np.int64)
    n = length[used]
    ends = np.cumsum(n)
    flat = pool[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(start[used], n)]
    offsets = np.concatenate([[0], ends])[np.cumsum(sizes)]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
