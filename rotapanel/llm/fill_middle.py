"""Fill-in-middle transformation, with cuts found by a learned rank index.

A text is cut into tokens (white space and the word behind it; white space at the end is one token).
Two hashed ranks choose where the prefix and the middle end. The offset of a rank comes from a
piecewise-linear index over all boundaries of the text: each segment is a line that stays within
``BOUND`` bytes of its boundaries, found by narrowing the cone of slopes that still fit; a residual
of one byte per boundary makes the prediction exact. The index takes about one byte a token.

Only a plain text can hold a marker, and a marker cannot arise where parts meet, so the parts of an
output are found again by splitting it at its markers (``restored``).

Cases: null texts count as empty, and empty texts are plain; rows without id are hashed as
an empty id; repeated rows each come back; an empty table gives an empty result; extra columns stay,
those named like an added column are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotapanel.llm.hashing import slices, text_bytes

BOUND = 120  # bytes between a boundary and its line; with rounding it must fit int8
AHEAD = 256  # boundaries looked at together, doubled while a segment lasts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ["plain", "psm", "spm"]
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class RankIndex:
    """Offsets by rank: lines of bounded error and the residual of each rank."""

    first: np.ndarray  # rank where each segment starts
    base: np.ndarray  # offset there
    slope: np.ndarray
    residual: np.ndarray  # int8, one for each rank

    def predict(self, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[k] + np.rint((rank - self.first[k]) * self.slope[k]).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        return self.predict(rank) + self.residual[rank]


def fit_index(offsets: np.ndarray, bound: int = BOUND) -> RankIndex:
    """Segments as long as one line can follow ``offsets`` within ``bound``."""
    first, base, slope = [], [], []
    at, n = 0, len(offsets)
    while at < n:
        first.append(at)
        base.append(int(offsets[at]))
        low, high, end, ahead = -np.inf, np.inf, at + 1, AHEAD
        while end < n:
            stop = min(n, end + ahead)
            steps = np.arange(end - at, stop - at)
            rise = offsets[end:stop] - offsets[at]
            # The slopes that fit every boundary so far.
            lows = np.maximum(np.maximum.accumulate((rise - bound) / steps), low)
            highs = np.minimum(np.minimum.accumulate((rise + bound) / steps), high)
            fit = lows <= highs
            took = len(fit) if fit.all() else int(np.argmin(fit))
            if took:
                low, high = lows[took - 1], highs[took - 1]
            end += took
            if took < len(fit):
                break
            ahead *= 2
        slope.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    index = RankIndex(np.array(first), np.array(base), np.array(slope), np.zeros(n, np.int8))
    index.residual = (offsets - index.predict(np.arange(n))).astype(np.int8)
    return index


def boundaries(raw: np.ndarray) -> np.ndarray:
    """0 and the end of each token of a text's bytes."""
    if not len(raw):
        return np.zeros(1, np.int64)
    space = _SPACE[raw]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.concatenate([[0], ends, [len(raw)]])


def _characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _draw(key: Column, seed: int, group: int) -> Column:
    """The hash's eight hex digits of a group (from 0 on) as a number."""
    digits = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    table: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, suffix_first: int = 80
) -> DataFrame:
    """Adds n (tokens), form, prefix_chars, middle_chars and output.

    ``rate`` percent of texts are transformed, ``suffix_first`` percent of these put the suffix first.
    """
    kept = [c for c in table.columns if c not in ADDED and c != text]
    marked = F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit("<[PSM]>"))
    plain = (F.coalesce(F.length(text), F.lit(0)) == 0) | marked | (_draw(F.col(key), seed, 2) % 100 >= rate)
    form = F.when(plain, 0).when(_draw(F.col(key), seed, 3) % 100 < suffix_first, 2).otherwise(1)
    rows = table.select(
        F.col(text).alias("_text"), _draw(F.col(key), seed, 0).alias("_one"), _draw(F.col(key), seed, 1).alias("_two"),
        form.alias("_form"), F.struct(*kept).alias("_kept"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                raw, off = text_bytes(batch.column(0))
                one, two, forms = (batch.column(k).to_numpy() for k in (1, 2, 3))
                tokens, prefix, middle, out = [], [], [], []
                for k in range(batch.num_rows):
                    data = raw[off[k] : off[k + 1]]
                    index = fit_index(boundaries(data))
                    n = len(index.residual) - 1
                    tokens.append(n)
                    if forms[k] == 0:
                        prefix.append(None)
                        middle.append(None)
                        out.append(data.tobytes())
                        continue
                    cuts = np.sort(np.array([one[k] % (n + 1), two[k] % (n + 1)]))
                    a, b = index.offset(cuts)
                    prefix.append(_characters(data[:a]))
                    middle.append(_characters(data[a:b]))
                    parts = {"P": data[:a].tobytes(), "M": data[a:b].tobytes(), "S": data[b:].tobytes()}
                    order = "SPM" if forms[k] == 2 else "PSM"
                    out.append(b"".join(b"<%s>" % c.encode() + parts[c] for c in order))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(4), batch.column(0), pa.array(tokens, pa.int64()), pa.array(forms.astype(np.int32)), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    schema.names,
                )

    schema = T.StructType([rows.schema["_kept"], rows.schema["_text"]])
    schema = schema.add("_n", "long").add("_form", "integer").add("_prefix", "long").add("_middle", "long").add("_output", "string")
    done = rows.mapInArrow(run, schema)
    return done.select(
        *[F.col("_text").alias(c) if c == text else F.col("_kept").getField(c).alias(c) for c in table.columns if c not in ADDED],
        F.col("_n").alias("n"),
        F.get(F.array(*map(F.lit, FORMS)), F.col("_form")).alias("form"),
        F.col("_prefix").alias("prefix_chars"), F.col("_middle").alias("middle_chars"), F.col("_output").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>", 4)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
