"""Nearest-time matching, percentiles, encoding, packing and garbled text: brute force, exact round trips, held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reedbed.llm import bpe, garble, nearest_time, packing, quantiles
from reedbed.llm.nearest_time import nearest_in_time
from reedbed.llm.quantiles import combine, multi_select, percentiles, summarise

DAY = 86_400


def _frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["i", "e", "t", "extra"]).assign(t=lambda d: pd.to_datetime(d.t, unit="s")))


def test_nearest_in_time_against_brute_force(spark):
    rng = np.random.default_rng(0)
    a = [(i, "hot" if i % 3 == 0 else f"e{i % 5}", int(rng.integers(0, 400 * DAY)), "x") for i in range(600)]
    b = [(1000 + i, "hot" if i % 3 == 0 else f"e{i % 6}", int(rng.integers(0, 400 * DAY)), "y") for i in range(500)]
    b += [(5000, a[0][1], a[0][2] + 50, "t"), (5001, a[0][1], a[0][2] - 50, "t"), (4999, a[0][1], a[0][2] - 50, "t"), b[0]]
    b += [(6000, a[7][1], a[7][2] + 3 * DAY, "edge")]
    got = {r["left_id"]: (r["right_id"], r["gap_us"]) for r in nearest_in_time(_frame(spark, a + a[:9]), _frame(spark, b), "e", "t", "i", 3 * DAY, rows_per_task=200).collect()}
    want = {}
    for i, e, t, _ in a:
        near = [(abs(u - t), u - t, j) for j, f, u, _ in set(b) if f == e and abs(u - t) <= 3 * DAY]
        if near:
            d = min(near)
            want[i] = (d[2], d[1] * 1_000_000)
    assert got == want and got[a[0][0]][0] == 4999


def test_nearest_in_time_of_dense_entities(spark, monkeypatch):
    """Entities cut by rank give the pairs of uncut ones: bursts, equal instants, stretches of one table only."""
    rng = np.random.default_rng(9)
    burst = lambda i, lo, n, e, x: [(i + k, e, int(t), x) for k, t in enumerate(rng.integers(lo, lo + 3000, n))]
    a = burst(0, 0, 400, "d", "x") + burst(1000, 9 * DAY, 300, "d", "x") + burst(2000, 0, 50, "s", "x")
    b = burst(10_000, 1000, 500, "d", "y") + burst(12_000, 5 * DAY, 200, "d", "y") + burst(14_000, 0, 60, "s", "y")
    pairs = lambda **k: {tuple(r) for r in nearest_in_time(_frame(spark, a), _frame(spark, b), "e", "t", "i", 4 * DAY, **k).collect()}
    whole = pairs()
    assert len(whole) == 750 and pairs(cell_rows=40) == whole
    monkeypatch.setattr(nearest_time, "is_short", lambda df: False)
    assert pairs(cell_rows=40) == whole


def test_nearest_in_time_nulls_and_empty(spark):
    rows = _frame(spark, [(1, "a", 0, None), (2, "b", 5, None)])
    nulls = rows.withColumn("e", F.when(F.col("i") == 1, F.col("e")))
    assert [r["left_id"] for r in nearest_in_time(nulls, rows, "e", "t", "i", 10).collect()] == [1]
    assert nearest_in_time(rows.where("false"), rows, "e", "t", "i", 10).count() == 0
    assert nearest_in_time(rows, rows.withColumn("t", F.lit(None).cast("timestamp")), "e", "t", "i", 10).count() == 0


Q = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


def _values(spark, n=4000):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"i": np.arange(n), "g": ["hot" if k % 3 == 0 else f"g{k % 40}" for k in range(n)], "y": rng.integers(2000, 2005, n), "v": np.round(rng.normal(0, 1, n), 2)})
    pdf.loc[::97, "v"] = np.nan
    return pdf, spark.createDataFrame(pd.concat([pdf, pdf.iloc[:300]])).withColumn("v", F.when(F.col("i") % 101 != 0, F.col("v")))


@pytest.mark.parametrize("block", [50, 100_000])
def test_percentiles_equal_numpy(spark, block):
    pdf, df = _values(spark)
    pdf = pdf[(pdf.i % 101 != 0) & pdf.v.notna()]
    got = percentiles(df, ["g"], "v", "i", Q, block=block).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "n"] == len(part)
        assert np.allclose([got.loc[g, k] for k in Q], np.quantile(part.v, list(Q.values())))
    assert (got.rank_error == 0).all() and percentiles(df.where("false"), ["g"], "v", "i", Q).count() == 0


def test_combined_summaries_keep_their_bound(spark):
    pdf, df = _values(spark)
    pdf = pdf[(pdf.i % 101 != 0) & pdf.v.notna()]
    for block in (40, 100_000):
        parts = summarise(df, ["g", "y"], "v", "i", points=16, block=block)
        assert parts.select(F.sum("n")).first()[0] == len(pdf) and parts.select(F.sum(F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] == len(pdf)
        for r in combine(parts, ["g"], Q, points=16).collect():
            v = np.sort(pdf[pdf.g == r["g"]].v)
            for k, q in Q.items():
                lo, hi = np.searchsorted(v, r[k], "left"), np.searchsorted(v, r[k], "right")
                assert lo - 1e-9 <= q * len(v) + r["rank_error"] * len(v) and hi + 1e-9 >= q * len(v) - r["rank_error"] * len(v)


def test_multi_select_ties_and_ranks(spark, monkeypatch):
    v = np.sort(np.random.default_rng(2).integers(0, 9, 700).astype(float))
    parts = [("a", np.sort(p).tolist()) for p in np.array_split(np.random.default_rng(3).permutation(v), 9)]
    blocks = spark.createDataFrame([*parts, ("b", [5.0]), ("b", [4.0, 6.0])], "key string, vals array<double>")
    wanted = spark.createDataFrame([("a", k, 700) for k in (0, 100, 350, 699)] + [("b", k, 3) for k in range(3)], "key string, rank bigint, n bigint")
    for last, short in ((0, 4096), (40, 4096), (10_000, 4096), (0, 0)):
        monkeypatch.setattr(quantiles, "SHORT_STATE", short)
        found = {(r["key"], r["rank"]): r["value"] for r in multi_select(blocks, wanted, last).collect()}
        assert [found["a", k] for k in (0, 100, 350, 699)] == [v[k] for k in (0, 100, 350, 699)] and [found["b", k] for k in range(3)] == [4.0, 5.0, 6.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(allow_nan=False) | st.integers(-3, 3), min_size=1, max_size=60), min_size=1, max_size=5), st.integers(1, 9))
def test_select_equals_sorting(groups, part):
    values = [np.array(g, float) for g in groups]
    got = quantiles.select(values, [np.arange(len(v)) for v in values], part)
    assert all(np.array_equal(g, np.sort(v)) for g, v in zip(got, values, strict=True))


def test_percentiles_null_keys_and_clashing_names(spark):
    rows = [(i, None if i % 2 else "a", None if i % 3 else 7, float(i), "x") for i in range(90)]
    df = spark.createDataFrame(rows, "i int, g string, y int, v double, vals string")
    for block in (7, 1000):
        got = {(r["g"], r["y"]): (r["n"], r["p50"]) for r in percentiles(df, ["g", "y"], "v", "i", Q, block=block).collect()}
        for (g, y), (n, m) in got.items():
            own = [v for _, a, b, v, _ in rows if (a, b) == (g, y)]
            assert n == len(own) and m == np.median(own)
        assert len(got) == 4


def _reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "a", "\r\n\n x\t", "<|endoftext|> and <|startoftext|>", "don't won't I'LL", "é é ｘ 𝔘 👩‍🌾", "中文分词" * 30, "a" * 5000, "ab" * 4000, "9" * 999, "\x00� ", "Индекс NDVI 0,35"]


def test_encoding_equals_the_library(spark):
    reference, encode = _reference(), bpe.encoder(bpe.vocabulary_path())
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcdethes  aaoéж中\n1'") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    assert all(encode(t) == reference(t) for t in texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    assert got[len(TEXTS)] == [] and all(got[i] == reference(t) for i, t in enumerate(TEXTS))
    assert bpe.encode_corpus(df.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_round_trip(text):
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in bpe.encoder(bpe.vocabulary_path())(text)) == text.encode()


def test_rank_queue_order():
    q, rng = bpe.RankQueue(), random.Random(5)
    items = [(rng.randrange(50_000), rng.randrange(10_000)) for _ in range(3000)]
    for x in items:
        q.push(*x)
    assert [q.pop() for _ in items] == sorted(items) and q.pop() is None


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y] for x in range(16) for y in range(16)])
    key = packing.hilbert_key(cells, 4)
    order = cells[np.argsort(key)]
    assert sorted(key) == list(range(256)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_pack_is_whole_and_tight(spark):
    rng, encode = random.Random(6), bpe.encoder(bpe.vocabulary_path())
    words = "reed river mast band salt dune poplar tamarisk".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20, 60, 200])))) for i in range(900)] + [(2000, "dune " * 700), (2001, None), (2002, ""), (2003, "dune " * 256), (2004, "dune " * 256)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    size = {i: len(encode(t)) for i, t in docs if t}
    got = packing.pack(df, capacity=256, stretch=300).toPandas()
    assert set(got.doc_id) == set(size)
    fill = Counter()
    for r in got.itertuples():
        n = size[r.doc_id]
        assert pd.isna(r.piece) == (n <= 256)
        fill[r.container] += n if n <= 256 else min(256, n - 256 * int(r.piece))
    assert max(fill.values()) <= 256 and sum(fill.values()) == sum(size.values())
    assert sum(fill.values()) / (256 * len(fill)) > 0.97
    assert (got.groupby("doc_id").container.count() == [max(1, -(-size[d] // 256)) for d in sorted(size)]).all()
    assert packing.pack(df.where("false")).count() == 0


def test_containers_hold_neighbours_of_the_curve(spark):
    rng = random.Random(8)
    themes = [[f"{t}{k}" for k in range(40)] for t in ("reed", "band", "salt", "mast", "dune")]
    docs = [(i, " ".join(rng.choice(themes[i % 5]) for _ in range(rng.randint(10, 60)))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {k: packing.packing_quality(packing.packed_line(df, capacity=512, window=100, keep=k), 512).first() for k in (3, 1000)}
    assert got[3]["over"] == got[1000]["over"] == 0 and got[3]["fill"] > 0.97 and got[3]["tokens"] == got[1000]["tokens"]
    assert got[3]["reach"] < 300 and got[3]["reach"] < got[3]["reach_random"] / 3 and got[3]["reach"] <= got[1000]["reach"]


PHRASES = ["Le relevé de l’été montre une forêt clairsemée près de la rivière.", "Die Lücke wurde nicht geschlossen; die Höhe beträgt über fünf Meter.", "Индекс менялся за сезон, что обычно для поймы и старого русла.", "传感器故障持续多日,该段记录不可用。",
           "Ağaç sayısı düşük, ırmak kıyısı çatladı ve göl küçüldü.", "A estação não funcionou; a copa está seca no verão.", "Ningún sensor funcionó durante la última inundación del año."]


@pytest.fixture(scope="module")
def notes(spark):
    rng, rows, was = random.Random(7), [], {}
    ways = [("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "cp437"), ("utf_8", "mac_roman"), ("utf_8", "cp1251")]
    for i in range(1400):
        text = " ".join(rng.choice(PHRASES) for _ in range(rng.randint(1, 5))) + f" [{rng.randint(1, 99)}]"
        if i % 14 == 0:
            start = rng.randrange(0, 20)
            a, b = ways[i // 14 % len(ways)]
            made = garble.garbled(text, a, b, start, start + rng.randint(25, 120))
            if made != text:
                was[i] = text
                text = made
        rows.append((i, text))
    extra = [(5000, None), (5001, ""), (5002, "plain ascii"), (5003, "Ningún sensor funcion� durante"), (5004, "½ 👩‍🌾 VEGETAÇÃ½O")]
    return spark.createDataFrame(rows + extra, "doc_id bigint, text string"), was


def test_garbled_found_and_restored(notes):
    df, was = notes
    got = garble.find_garbled(df.withColumn("lost", F.lit("clash"))).toPandas().set_index("doc_id")
    found = set(got.index)
    assert 5003 in found and not found & {5000, 5001, 5002, 5004}
    hits = found & set(was)
    assert len(hits) / len(was) > 0.97 and len(found - set(was) - {5003}) <= 3
    exact = [i for i in hits if got.loc[i, "restored"] == was[i]]
    lossless = [i for i in hits if garble.LOST not in df.where(f"doc_id = {i}").first()["text"]]
    assert len(exact) / len(lossless) > 0.9
    assert got.loc[5003, "restored"].startswith("Ningún sensor funcionó")


def test_garble_empty(spark):
    assert garble.find_garbled(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_margin_prefers_separation():
    assert 8.9 < garble.chosen_margin([0.0] * 50 + [8.9], [20.0, 30.0, 9.6] * 20) <= 9.6


def test_chains_over_arrays_equal_their_units():
    rng = random.Random(1)
    letters = "abc éèüß–“”€ÐÑдвеИïÃ©æœÂ °±²µ·×ñçõ中文的了РС" + "Ð°Ñ‚ÐµÃ©â€™â€œ" * 2
    for chain in garble.chains():
        if chain.fast and not chain.name.endswith("twice"):
            for _ in range(60):
                t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
                new, kept = chain.fast(*garble.code_points([t]))
                assert "".join(map(chr, new)) == "".join(n[0] if n else o for o, n in chain.units(t)), (chain.name, t)


def test_model_over_arrays_equals_the_model():
    counts = Counter()
    garble.count_grams(PHRASES, counts)
    context = Counter()
    for g, n in counts.items():
        if len(g) > 1:
            context[g[:-1]] += n
    model = garble.Model(dict(counts), dict(context), sum(n for g, n in counts.items() if len(g) == 1))
    text = "L’ÉTÉ était là; Индекс МЕНЯЛСЯ 传感器 xyz � ½ 👩‍🌾 Höhe"
    codes, _ = garble.code_points([text])
    assert np.allclose(garble.FastModel(model).each(codes), model.each(text))
    assert counts["é"] == sum(p.count("é") for p in PHRASES) and counts["été"] == sum(p.count("été") for p in PHRASES)


def test_restoring_does_not_depend_on_the_order_of_texts(notes):
    df, was = notes
    a, b = (garble.find_garbled(df.orderBy(F.col("doc_id") * s)).toPandas().sort_values("doc_id").restored.tolist() for s in (1, -1))
    assert a == b


def test_many_stretches_of_one_text_are_all_restored(notes):
    df, _ = notes
    clean = " ".join(PHRASES[i % len(PHRASES)] for i in range(300))
    broken = " ".join(garble.garbled(PHRASES[i % len(PHRASES)], "utf_8", "latin_1", 0, 200) for i in range(300))
    spark = df.sparkSession
    got = garble.find_garbled(df.unionByName(spark.createDataFrame([(9000, broken)], df.schema))).where("doc_id = 9000").first()
    assert sum(x != y for x, y in zip(got["restored"], clean, strict=False)) < 0.02 * len(clean)


def test_share_that_comes_back(notes):
    df, was = notes
    got = garble.regained(df.where(~F.col("doc_id").isin(list(was)))).toPandas()
    assert len(got) >= 6 and (got.found * got.n).sum() / got.n.sum() > 0.97 and (got.exact * got.n).sum() / got.n.sum() > 0.9


def test_model_and_margin_take_all_records(spark):
    rows = [(i, f"Höhe {i}: " + PHRASES[i % len(PHRASES)]) for i in range(3000)] + [(5000 + i, chr(0x4E00 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc bigint, t string")
    shared, margin, _ = garble._trained(df)
    counts = Counter()
    garble.count_grams([t for _, t in rows if garble.is_plain(t)], counts)
    assert {garble.unpacked(int(k)): n for k, n in zip(*shared.value, strict=True)} == counts
    scored = garble._scored(df, shared).where("n is not null").groupBy("made").agg(F.sum("n").alias("n")).toPandas().set_index("made").n
    made = [garble.garbled_on_purpose(r.t, abs(r.h)) for r in df.withColumn("h", F.xxhash64("t")).collect() if garble.is_plain(r.t)]
    assert scored[False] == len(made) > 3000 and scored[True] == sum(m is not None for m in made)
    assert margin in garble.MARGINS


def test_texts_garbled_in_a_known_way_reach_the_same_margins():
    counts = Counter()
    garble.count_grams(PHRASES * 50, counts)
    context = Counter()
    for g, n in counts.items():
        if len(g) > 1:
            context[g[:-1]] += n
    model = garble.Model(dict(counts), dict(context), sum(n for g, n in counts.items() if len(g) == 1))
    made = [m for i in range(400) if (m := garble.garbled_on_purpose(PHRASES[i % len(PHRASES)], 7919 * i))]
    fast = garble.Restorer(model, 6.0).top_gains_of_made(made, garble.MARGINS[-1])
    all_chains = [max((e[3] for e in edits), default=0.0) for edits in garble.Restorer(model, 6.0).first([t for t, _ in made])]
    assert len(made) > 200 and (garble.margins_reached(fast) == garble.margins_reached(np.array(all_chains))).all()


def test_packed_model_equals_the_model_of_dictionaries():
    counts = Counter()
    garble.count_grams([*PHRASES, "\x00é\x00 👩‍🌾"], counts)
    context = Counter()
    for g, n in counts.items():
        if len(g) > 1:
            context[g[:-1]] += n
    plain = garble.Model(dict(counts), dict(context), sum(n for g, n in counts.items() if len(g) == 1))
    said = sorted((garble.packed(g), n) for g, n in counts.items())
    model = garble.Model.of(*(np.array(x, dtype=np.int64) for x in zip(*said, strict=True)))
    text = "L’ÉTÉ était là; Индекс МЕНЯЛСЯ 传感器 xyz � ½ \x00é👩‍🌾 Höhe"
    assert model.total == plain.total and np.allclose(model.each(text), plain.each(text))
    for before in ("", "é", "ét", "传感", "q"):
        seen = {g[-1] for g in counts if g[:-1] == before and ord(g[-1]) > 127 and not garble.LEFTOVER.match(g[-1])}
        assert set(model.fast.following(before)) == seen
