"""Sequence operators: token windows, BIO decoding, labels for tokens, boundary refinement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions import vocab
from . import kernels

#: O, B-NAME, I-NAME, ... in the order of the label dimension.
BIO_LABELS = ("O", *(f"{p}-{label}" for label in vocab.LABELS for p in "BI"))


def token_windows(tokens: Column, max_length: int = 256, stride: int | None = None) -> Column:
    """array<struct<win int, first int, tokens array>> of overlapping windows of max_length - 2 tokens.

    The step is the stride, half of max_length by default, kept between 1 and the window.
    The last window is the first that reaches the end; no tokens give one empty window.
    """
    body = max(1, max_length - 2)
    step = min(max(1, max_length // 2 if stride is None else stride), body)
    n = F.size(tokens)
    count = F.greatest(F.ceil((n - body) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count),
        lambda w: F.struct(w.alias("win"), (w * step).alias("first"), F.slice(tokens, w * step + 1, F.lit(body)).alias("tokens")),
    )


def scored_tokens(tokens: Column) -> Column:
    """From struct<start_pos, end_pos, probs array<double>> the best kind of each token: its probability, that of O, whether it begins."""
    kinds = range(len(vocab.LABELS))

    def best(t: Column) -> Column:
        masses = F.array(
            *(
                F.struct(
                    (F.get(t["probs"], F.lit(2 * k + 1)) + F.get(t["probs"], F.lit(2 * k + 2))).alias("p"),
                    F.lit(-k).alias("order"), F.lit(vocab.LABELS[k]).alias("label"),
                    (F.get(t["probs"], F.lit(2 * k + 1)) >= F.get(t["probs"], F.lit(2 * k + 2))).alias("begins"),
                )
                for k in kinds
            )
        )
        top = F.array_max(masses)
        return F.struct(
            t["start_pos"].alias("start_pos"), t["end_pos"].alias("end_pos"), top["label"].alias("label"),
            top["p"].alias("p"), F.get(t["probs"], F.lit(0)).alias("p_o"), top["begins"].alias("begins"),
        )

    return F.transform(tokens, best)


def decode_bio(tokens: Column, text: Column, threshold: float = 0.05) -> Column:
    """Spans of tokens in order (struct<start_pos, end_pos, probs>, a probability for each of BIO_LABELS); the score is the least of the span's tokens.

    A kind opens if its probability is above that of O, also without a beginning token; the
    same kind goes on unless the token begins; any other kind or O closes. Tokens without width or
    with blanks only are skipped. Blanks at the borders are trimmed, spans below the threshold are dropped. All
    tokens of a batch are decoded together; null tokens give no spans.
    """
    run = lambda own, texts: kernels.token_spans(own, texts, vocab.LABELS, threshold)
    return kernels.arrow_function(run, f"array<{S.SPAN}>")(tokens, text)


def bio_tags(spans: Column, tokens: Column) -> Column:
    """For each token the tag of the first span it overlaps: B if it holds the span's start or lies before it; null for tokens without width."""
    first = S.by_position(S.present(spans))

    def tag(t: Column) -> Column:
        hit = F.get(F.filter(first, lambda s: S.overlaps(s, t)), F.lit(0))
        mark = F.concat(F.when(t["start_pos"] <= hit["start_pos"], "B-").otherwise("I-"), hit["label"])
        return F.when(t["end_pos"] > t["start_pos"], F.coalesce(mark, F.lit("O")))

    return F.transform(tokens, tag)


def refined_borders(text: str, start: int, end: int) -> tuple[int, int]:
    """Borders without symbols on either side and without honorifics and particles at the end; as given if nothing would be left.

    Each round trims symbols and one honorific, and a particle only if that changed nothing.
    """
    value = text[start:end]
    low = start
    while value:
        tail = value.rstrip(vocab.TRIM_CHARS)
        body = tail.lstrip(vocab.TRIM_CHARS)
        low += len(tail) - len(body)
        for words in (vocab.HONORIFICS, vocab.PARTICLES if body == value else ()):
            ending = next((w for w in words if len(body) > len(w) and body.endswith(w)), "")
            if ending:
                body = body[: -len(ending)]
                break
        if body == value:
            return low, low + len(value)
        value = body
    return start, end


def refined(spans: Column, text: Column) -> Column:
    """Names and addresses with refined borders, all other spans as they are. A fixpoint, so it runs in Python, batch by batch."""

    def run(lists: pa.ListArray, texts: pa.Array) -> pa.ListArray:
        row, flat = kernels.rows_of(lists)
        fields = {c: flat.field(c) for c in ("start_pos", "end_pos", "label", "text", "score", "source")}
        start, end, value = (fields[c].to_pylist() for c in ("start_pos", "end_pos", "text"))
        body = texts.to_pylist()
        asked = pc.fill_null(pc.is_in(fields["label"], pa.array(vocab.REFINED_LABELS)), False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(asked).tolist():
            t = body[row[i]]
            if t is not None:
                borders = refined_borders(t, start[i], min(end[i], len(t)))
                if borders != (start[i], end[i]):
                    start[i], end[i] = borders
                    value[i] = t[borders[0] : borders[1]]
        fields |= {"start_pos": pa.array(start, pa.int32()), "end_pos": pa.array(end, pa.int32()), "text": pa.array(value, pa.string())}
        return kernels.lists_of(row, len(lists), fields)

    return kernels.arrow_function(run, f"array<{S.SPAN}>")(S.plain(S.present(spans)), text)


def agreement(tokens: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Token agreement of two decoders: all tokens, tokens that are no O in `a`, documents labelled identically.

    An empty table gives one row of zeros.
    """
    same = F.col(a).eqNullSafe(F.col(b))
    pii = F.col(a) != "O"
    docs = tokens.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(same.cast("long")).alias("eq"), F.sum(F.coalesce(pii, F.lit(False)).cast("long")).alias("pii"),
        F.sum((F.coalesce(pii, F.lit(False)) & same).cast("long")).alias("pii_eq"),
    )
    share = lambda x, y: F.round(F.coalesce(F.try_divide(F.sum(x), F.sum(y)), F.lit(0.0)), 6)
    return docs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), share("eq", "n").alias("agreement"),
        F.coalesce(F.sum("pii"), F.lit(0)).alias("n_pii_tokens"), share("pii_eq", "pii").alias("pii_agreement"),
        F.coalesce(F.sum((F.col("eq") == F.col("n")).cast("long")), F.lit(0)).alias("identical_docs"),
        F.count("*").alias("n_docs"),
    )


def token_metrics(tokens: DataFrame, gold: str, predicted: str) -> DataFrame:
    """tp, fp, fn of token labels: a wrong label that isn't O counts as both. Rows with a null label are ignored."""
    g, p = F.col(gold), F.col(predicted)
    rows = tokens.where(g.isNotNull() & p.isNotNull())
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(
        count((g == p) & (g != "O")).alias("tp"), count((p != "O") & (g != p)).alias("fp"), count((g != "O") & (g != p)).alias("fn")
    )
