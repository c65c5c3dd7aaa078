import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.llm import fill_middle


def by_hand(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(made):
    rows = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
    return rows


def test_odd_rows_and_clashing_columns(spark, odd, no_rows):
    df = odd.withColumn("n", F.lit("old")).withColumn("output", F.lit("old")).withColumn("_text", F.lit("own"))
    rows = check(fill_middle.fill_in_middle(df))
    assert len(rows) == odd.count() and {r._text for r in rows} == {"own"} and {r.epoch for r in rows} == {"e"}
    assert fill_middle.fill_in_middle(no_rows).count() == 0


def test_texts_of_all_kinds(spark):
    texts = ["a", " a", "a ", "  ", "a<P>b", "x <S", "S> y <", "<P <S M>", "éè 中文 \U0001f600 z", "\n\na\tb\x0bc\x0cd\re   f g"]
    rows = check(fill_middle.fill_in_middle(spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_a_long_text_and_a_long_token(spark):
    rng = np.random.default_rng(1)
    uneven = " ".join("w" * k for k in rng.integers(1, 40, 60_000)) + " " + "y" * 300_000 + " tail" * 5_000
    check(fill_middle.fill_in_middle(spark.createDataFrame([(i, uneven) for i in range(6)], "doc_id long, text string")))


@pytest.mark.parametrize("seed", range(5))
def test_the_index_is_exact_and_small(seed):
    rng = np.random.default_rng(seed)
    steps = rng.integers(1, [3, 12, 60, 400, 2][seed], 20_000)
    steps[rng.integers(0, len(steps), 30)] += rng.integers(0, 100_000, 30)
    offsets = np.concatenate([[0], np.cumsum(steps)])
    index = fill_middle.fit_index(offsets)
    rank = rng.permutation(len(offsets))
    assert (index.offset(rank) == offsets[rank]).all()
    assert np.abs(offsets - index.predict(np.arange(len(offsets)))).max() <= fill_middle.BOUND + 1
    assert seed == 3 or len(index.first) < len(offsets) / 50


def test_a_segment_ends_only_where_no_line_fits():
    offsets = np.cumsum(np.concatenate([np.full(3_000, 5), np.full(3_000, 9)]))
    assert len(fill_middle.fit_index(offsets).first) <= 4 and len(fill_middle.fit_index(offsets[:3_000]).first) == 1
