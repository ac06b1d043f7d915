"""Token counts of the sections of documents, by offset-mapped attribution.

A document is encoded once, as a whole. The lengths of its tokens' bytes give
every token's span; the spans are interval-joined with those of the sections
(two sorted lists, by binary search). A token across a boundary goes to one
section by a stated rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import bound_batches, text_buffer

RULES = ("majority", "start", "end")
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODERS: dict[Any, tuple[Any, np.ndarray]] = {}
#: Runs of white space of this length or more are taken out before the tokenizer's pattern sees them.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{256,}")


def encoder(key: tuple[str, bytes, str]) -> tuple[Any, np.ndarray]:
    """The tokenizer of a vocabulary file's content and the byte length of each token; made once in a worker."""
    if key[0] not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, key[1].splitlines())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _ENCODERS[key[0]] = tiktoken.Encoding(key[0], pat_str=key[2], mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODERS[key[0]]


def encode_whole(enc: Any, text: str, cut_runs: bool) -> list[int]:
    """The tokens of a text.

    The backtracking of the tokenizer's pattern overflows on very long runs of
    white space. The default pattern makes one piece of such a run, up to the
    last of its characters if text follows, so a run is cut out there and its
    piece encoded by itself, with the same tokens.
    """
    out: list[int] = []
    at = 0
    for run in LONG_RUN.finditer(text) if cut_runs else ():
        stop = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + enc.encode_ordinary(text[at:])


def allocate(ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
    """(tokens of each span, tokens outside all spans, tokens across a boundary).

    ``ends``: where each token ends; ``low``, ``high``: the spans, in order and
    without overlap. All in bytes.
    """
    starts = np.concatenate(([0], ends[:-1]))
    edges = np.unique(np.concatenate((low, high)))
    crossing = np.searchsorted(edges, ends, "left") > np.searchsorted(edges, starts, "right")
    at = starts if rule != "end" else ends - 1
    at = at.copy()
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            s, e = starts[t], ends[t]
            cuts = np.concatenate(([s], edges[np.searchsorted(edges, s, "right") : np.searchsorted(edges, e, "left")], [e]))
            at[t] = cuts[np.argmax(np.diff(cuts))]  # the first of the longest pieces
    owner = np.searchsorted(low, at, "right") - 1
    inside = owner >= 0
    inside[inside] = at[inside] < high[owner[inside]]
    return np.bincount(owner[inside], minlength=len(low)), int((~inside).sum()), int(crossing.sum())


def attribute_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    spans_col: str | None = None,
    rule: str = "majority",
    vocabulary: str = DEFAULT_VOCABULARY,
    pattern: str | None = None,
) -> DataFrame:
    """(id, n_tokens, n_sections, n_crossing, n_outside, section_tokens) of every row.

    ``spans_col``: an array of (start, end) code-point spans, in order and
    without overlap; without it the sections are the lines, each with the
    newline that ends it. ``section_tokens`` has the tokens of each section, in
    order; with ``n_outside``, those in no section, they add up to
    ``n_tokens``. ``n_crossing`` counts the tokens that touch more than one
    section (or one and none). ``rule``: such a token goes to the section with
    most of its bytes, the earlier one in a tie ("majority"), or to that of its
    first byte ("start") or its last ("end").

    White space of any length is encoded as the tokenizer would; with a
    ``pattern`` of your own, its runs are passed on as they are.

    A null or empty text has no token and, as lines, no section. Null spans
    are no spans; spans beyond the text are cut to it. Repeated rows are
    counted each for itself. Other columns of ``docs`` are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    cut_runs = pattern == public_tokenizers.PATTERN
    bound_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        key = docs.sparkSession.sparkContext.broadcast((vocabulary, f.read(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(key.value)
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            spans = batch.column(2).to_pylist() if spans_col else None
            rows: dict[str, list] = {k: [] for k in ("n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens")}
            for i in range(len(at) - 1):
                raw = data[at[i] : at[i + 1]]
                tokens = np.array(encode_whole(encode, raw.tobytes().decode("utf-8", "replace"), cut_runs), dtype=np.int64)
                ends = np.cumsum(lengths[tokens])
                if spans is None:
                    high = np.flatnonzero(raw == 10) + 1
                    if len(raw) and (not len(high) or high[-1] < len(raw)):
                        high = np.append(high, len(raw))
                    low = np.concatenate(([0], high[:-1])).astype(np.int64) if len(high) else high
                else:
                    pairs = np.array([(s["start"], s["end"]) for s in spans[i] or []], dtype=np.int64).reshape(-1, 2)
                    first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte of each code point
                    low, high = first[np.clip(pairs, 0, len(first) - 1)].T
                n, outside, crossing = allocate(ends, low, high, rule) if len(ends) else (np.zeros(len(low), np.int64), 0, 0)
                for k, v in zip(rows, (len(ends), len(low), crossing, outside, n), strict=True):
                    rows[k].append(v)
            kinds = {k: pa.int64() for k in rows} | {"section_tokens": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, kinds[k]) for k, v in rows.items()]], names=["id", *rows])

    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if spans_col:
        cols.append(F.transform(spans_col, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("spans"))
    out = docs.select(*cols).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_tokens long, n_sections long, n_crossing long, n_outside long, section_tokens array<long>")
    return out.withColumnRenamed("id", id_col)
