"""The corpus operators against plain versions: whole small tables and made-up edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.llm import catalog, common, components, counting, ftrl, jaccard, language, linking, mixing, packing, quality, rules, sharding, spotsigs, substrings, toxicity
from tessera.llm.common import salted_rank

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id")


@pytest.fixture(scope="module")
def query(spark):
    held = {}

    def run(name):
        if name not in held:
            held[name] = catalog.queries()[name](spark, FOLDER).toPandas()
        return held[name]

    return run


EDGE = "doc_id long, text string, source string, lang string, n_chars long, doc string, _row string, copies string, score string, _salt string, block string, `a.b` string"
SENTENCE = "one two three four five six seven eight nine ten eleven twelve " * 4


@pytest.fixture(scope="module")
def edge(spark):
    more = ("q",) * 7
    rows = [
        (1, "a b c d e f g h", "s1", "en", 1, *more), (1, "a b c d e f g h", "s1", "en", 1, *more), (2, None, None, None, None, *[None] * 7),
        (None, SENTENCE, "s2", "en", 3, *more), (9007199254740993, SENTENCE, "s2", "en", 3, *more), (4, "", "s1", "", 0, *more),
        (5, "  \n\t ", "s3", "", 0, *more), (6, "word " * 30000, "s3", "en", 9, *more), (7, "Ünïcödé " * 40, "s3", "de", 9, *more),
    ]
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="module")
def edge_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 0, 0), (7, 1, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


APPLIED = {
    "quality": lambda d, labels: quality.score_quality(d, quality.fit_quality(d, labels)),
    "toxicity": lambda d, labels: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)),
    "substrings": lambda d, labels: substrings.digests(d),
    "mixing": lambda d, labels: mixing.mix(d),
    "fingerprints": lambda d, labels: spotsigs.fingerprints(d),
    "jaccard": lambda d, labels: jaccard.join(d),
    "sharding": lambda d, labels: sharding.shard(d),
    "language": lambda d, labels: language.score_language(d, F.col("doc_id") != 4),
    "rules": lambda d, labels: rules.judge(d, labels),
}


@pytest.mark.parametrize("name", APPLIED)
def test_edges_give_a_row_for_each_row(edge, edge_labels, name):
    got = [r.doc_id for r in APPLIED[name](edge, edge_labels).select("doc_id").collect()]
    assert Counter(got) == Counter([1, 1, 2, None, 9007199254740993, 4, 5, 6, 7])
    assert APPLIED[name](edge.limit(0), edge_labels.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [lambda d, labels: quality.keep_quality(d, quality.fit_quality(d, labels)), lambda d, labels: jaccard.keep_first(d), lambda d, labels: substrings.dedup(d), lambda d, labels: mixing.take(d)])
def test_stages_keep_the_columns(edge, edge_labels, stage):
    out = stage(edge, edge_labels)
    assert out.columns == edge.columns and [t for _, t in out.dtypes] == [t for _, t in edge.dtypes]
    assert {r["_row"] for r in out.collect()} <= {"q", None}
    assert stage(edge.limit(0), edge_labels).count() == 0


def test_salted_rank_is_a_rank(spark):
    frame = spark.createDataFrame([(None if i % 4 == 0 else "ab"[i % 2], i) for i in range(200)], "k string, i int")
    got = salted_rank(frame, ["k"], [F.col("i")], F.col("i") % 7, "rank", "total").toPandas()
    for _, part in got.groupby("k", dropna=False):
        ordered = part.assign(s=part.i % 7).sort_values(["s", "i"])
        assert list(ordered["rank"]) == list(range(len(part))) and set(part.total) == {len(part)}


def test_clear_deletes_written_tables(spark):
    kept, before = common.materialize(spark.range(3), "kept"), len(common.WRITTEN)
    path = common.WRITTEN.pop()
    held, common.WRITTEN[:] = list(common.WRITTEN), [path]
    assert kept.count() == 3 and before > 0
    common.clear(spark)
    assert common.WRITTEN == [] and not spark._jvm.java.io.File(path.removeprefix("file:")).exists()
    common.WRITTEN[:] = held


# Classifiers


def test_quality_on_held_out_rows(query, docs):
    got = query("op1_quality_classifier").merge(pd.read_parquet(f"{FOLDER}/labels.parquet"), on="doc_id")
    assert len(query("op1_quality_classifier")) == len(docs)
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.97 and held.score.between(0, 1).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_on_held_out_rows(query, docs):
    got = query("op2_toxicity").merge(pd.read_parquet(f"{FOLDER}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    order = held.score.rank()
    n1, n0 = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    auc = (order[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert auc > 0.9 and (held[held.toxic == 0].predicted == 0).mean() > 0.97
    assert len(query("op2_toxicity")) == len(docs)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    kept = F.col("doc_id") % 2 == 0
    turned = labels.withColumn("quality", F.when(kept, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = quality.fit_quality(docs, labels, kept), quality.fit_quality(docs, turned, kept)
    assert np.array_equal(a.index, b.index) and np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    examples = [(np.unique(np.append(rng.integers(10, 1000, 30), 5 if y else 6)).astype(np.int32), y) for y in rng.integers(0, 2, 400)]
    index, weight, bias = ftrl._learn(examples, 10, ftrl.TrainConfig(alpha=1.0, l1=4.0, l2=0.0, epochs=5))
    w = dict(zip(index.tolist(), weight, strict=True))
    assert w[5] > 0 > w[6] and len(index) < 100


def test_features_of_skip_grams():
    f = ftrl.Features(bits=16, skips=(1, 2))
    row, feature = f.of(["a b c", None, "", "a b c"], ftrl.Hashes())
    assert Counter(row.tolist()) == {0: 6, 3: 6} and set(feature[row == 0]) == set(feature[row == 3])


def spark_hash(*values):
    """The engine's 64-bit hash of strings, long (int) and int (as a tuple of one) values, as a signed number."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_features(text, f):
    """Set of feature numbers, by scalar arithmetic on one token and one pair at a time."""
    odd, whole = [int(x) for x in ftrl.ODD], (1 << 64) - 1
    tokens = re.findall(r"\w+|[^\w\s]+", text.lower() if f.fold else text)
    found = set()

    def add(h, kind, skips):
        for i, x in enumerate(h):
            found.add(((x + kind + 1) * odd[0] & whole) >> (64 - f.bits))
            for skip in skips:
                if i + skip < len(h):
                    pair = (x * odd[1] & whole) ^ (h[i + skip] * odd[2] & whole) ^ ((skip + 8 * kind) * odd[3] & whole)
                    found.add((pair * odd[0] & whole) >> (64 - f.bits))

    words = [zlib.crc32(t.encode()) for t in tokens]
    add(words, 0, f.skips)
    if f.shapes:
        shape = lambda t: 1 if t.islower() else 3 if t.isupper() and len(t) > 1 else 2 if t.istitle() else 4 if t.isdigit() else 0
        add([(shape(t) or w) + 8 * (i > 0 and w == words[i - 1]) for i, (t, w) in enumerate(zip(tokens, words, strict=True))], 2, (1, 2))
    return found


@pytest.mark.parametrize(("name", "label", "by", "out", "module"), [("op1_quality_classifier", "quality", 5, 0, quality), ("op2_toxicity", "toxic", 3, 1, toxicity)])
def test_scores_of_a_plain_learner(spark, name, label, by, out, module):
    """Feature by feature in a dictionary, from the labels and texts to the score of every row."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (pd.read_parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    f, c = module.FEATURES, module.CONFIG
    held = {d: plain_features(t or "", f) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    taught = sorted((d for d in labels.doc_id if zlib.crc32(str(d).encode()) % by != out and d in held), key=lambda d: (spark_hash(int(d), (29,)), d))
    truth = dict(zip(labels.doc_id, labels[label], strict=True))
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= c.l1 else -(z[i] - math.copysign(c.l1, z[i])) / ((c.beta + math.sqrt(n[i])) / c.alpha + c.l2)
    p = lambda d: 1 / (1 + math.exp(-min(35, max(-35, sum(weight(i) for i in held[d]) + bias))))
    for _ in range(c.epochs):
        for d in taught:
            g = p(d) - truth[d]
            for i, w in [(i, weight(i)) for i in held[d]]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / c.alpha * w
                n[i] += g * g
            bias_n += g * g
            bias -= c.alpha * g / (c.beta + math.sqrt(bias_n))
    got = {r.doc_id: r for r in catalog.queries()[name](spark, folder).collect()}
    assert set(got) == set(held)
    for d, r in got.items():
        assert r.score == pytest.approx(p(d), abs=2e-4) and r.held_out == (zlib.crc32(str(d).encode()) % by == out)


# Substrings


def plain_removal(texts):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        covered, last = bytearray(len(data)), 0
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                for q in range(max(p, last), p + 100):
                    covered[q] = 1
                last = p + 100
            else:
                seen.add(window)
        kept = bytes(c for c, gone in zip(data, covered, strict=True) if not gone)
        spans = sum(1 for p in range(len(data)) if covered[p] and (p == 0 or not covered[p - 1]))
        out.append((len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_whole_table(query, docs):
    got = query("op3_suffix_array_dedup").set_index("doc_id")
    expected = plain_removal(docs.text)
    assert [tuple(r) for r in got.loc[docs.doc_id, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == expected


def test_substrings_made_up(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(rng.choice(list("abcdefgh é\n"), n))
    passage, line = noise(130), noise(60)
    texts = [noise(40) + passage + noise(90), passage, "x" * 500, "x" * 120, None, "", noise(99), line + noise(80), noise(30) + line + noise(70), "ab" * 300 + passage[10:125], passage[:99], noise(25) + passage + passage]
    texts += [noise(70) + passage + noise(70) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(frame).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts)


def test_rows_of_one_id_are_one_document(spark):
    text = "".join(np.random.default_rng(4).choice(list("abcdefgh"), 300))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.digests(frame).collect()) == [(1, 0), (1, 0), (2, 300)]


def test_run_index_statistics():
    rng = np.random.default_rng(5)
    contexts = [bytes(rng.choice([97, 98], 40).astype(np.uint8)) for _ in range(12)] * 2
    index = substrings.RunIndex(contexts, 60)
    length, place = index.statistics()
    text = b"".join(c + bytes([200 + i]) for i, c in enumerate(contexts))
    assert index.runs < index.size
    for p in range(index.size):
        n = length[p]
        assert place[p] != p or n == 0
        assert text[p : p + n] == text[place[p] : place[p] + n]
    order = sorted(range(index.size), key=lambda p: [(c, 1) if c < 200 else (-1, c) for c in text[p:]])
    for above, p in zip(order, order[1:], strict=False):
        common = 0
        while max(p, above) + common < index.size and text[p + common] == text[above + common]:
            common += 1
        assert length[p] == common


def test_index_and_settling_give_the_same_marks():
    rng = np.random.default_rng(6)
    base = bytes(rng.integers(97, 101, 200).astype(np.uint8))
    contexts = [bytes(rng.integers(97, 101, 20).astype(np.uint8)) + base[a : a + 130] for a in range(0, 60, 7)]
    doc = np.arange(len(contexts))
    spans = substrings.long_matches(doc, np.zeros(len(contexts), np.int64), contexts)
    for d, (c, (n, gone, _, _)) in enumerate(zip(contexts, plain_removal([c.decode() for c in contexts]), strict=True)):
        covered = set().union(*[set(range(a, b)) for i, a, b in spans if i == d])
        assert len(covered) == gone and n == len(c)


# Mixing, sharding: SQL does these


def test_sql_agrees(query):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    for name, statement in catalog.oracle_sql().items():
        ours, theirs = query(name), con.sql(statement).df()
        cells = lambda f: sorted(map(repr, f[sorted(f.columns)].map(lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v).astype(object).itertuples(index=False, name=None)))
        assert sorted(ours.columns) == sorted(theirs.columns) and cells(ours) == cells(theirs)


def test_mix_comes_near_targets(query):
    got = query("op4_mixing")
    assert (got.taken <= 2 * got["size"]).all()
    sums = got.groupby("target").agg(taken=("taken", "sum"), n=("source_size", "nunique")).reset_index()
    largest = got["size"].max()
    assert (abs(sums.taken - sums.target * sums.n) <= largest * sums.n).all()
    per_source = got.drop_duplicates(["target", "source_size"])
    assert per_source.target.sum() == pytest.approx(1.5 * per_source.source_size.sum(), rel=1e-9)
    assert (per_source.target <= 2 * per_source.source_size + 1e-9).all()


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 10, "d": 0}, {"x": 7}])
def test_targets_by_resharing(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2 * sizes[s] for s in over}
    assert got == pytest.approx({**capped, **share})


def test_shards_are_even_and_mixed(query, docs):
    got = query("op7_sharding").merge(docs[["doc_id", "text", "source"]], on="doc_id")
    counts = got.shard.value_counts()
    assert set(counts.index) == set(range(16)) and counts.max() - counts.min() <= 1
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))
    assert (got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text]).all() and (got["size"] == [len(t.encode()) + 1 for t in got.text]).all()
    share = pd.crosstab(got.shard, got.source)
    assert (share.max() - share.min()).max() <= 2


# Fingerprints


def test_edited_texts(query, docs):
    got = query("op5_fingerprints").set_index("doc_id")
    down = docs.sort_values("doc_id", ascending=False)
    texts, ids = list(down.text), list(down.doc_id)
    for i, (d, t) in enumerate(zip(ids, texts, strict=True)):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got.n_chars[d], got.edited_sha256[d]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    merged = docs.merge(got.reset_index(), on="doc_id")
    assert merged.groupby("text").fingerprint.nunique().max() == 1
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got.near_edited.mean() > 0.25 > 0.05 > got.near_next.mean()


def plain_signs(text):
    common, words = set(spotsigs.ANCHORS), re.findall(r"[^\W_]+|\|", text.lower())
    at = [i for i, w in enumerate(words) if w not in common]
    return {tuple([words[i - 1] if i else None, words[i], words[at[k + 1]] if k + 1 < len(at) else None]) for k, i in enumerate(at) if i == 0 or words[i - 1] in common}


def test_likeness_is_jaccard_of_chains(query, docs):
    got = query("op5_fingerprints").set_index("doc_id")
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    for d in list(texts)[1::9]:
        a, b = plain_signs(texts[d]), plain_signs(texts[d - 1])
        if a and b:
            assert len(got.fingerprint[d]) == 8 * len(a)
            assert got.near_next[d] == pytest.approx(len(a & b) / len(a | b))


def plain_jaccard(a, b):
    """Of the chains of two texts; texts without any are alike if they are equal."""
    x, y = plain_signs(a) or {a}, plain_signs(b) or {b}
    return len(x & y) / len(x | y)


def test_likeness_of_every_row(query, docs):
    got = query("op5_fingerprints").set_index("doc_id")
    down = docs.sort_values("doc_id", ascending=False)
    texts, ids = list(down.text), list(down.doc_id)
    for i, (d, t) in enumerate(zip(ids, texts, strict=True)):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        assert got.near_next[d] == pytest.approx(plain_jaccard(t, after))
        assert got.near_edited[d] == pytest.approx(plain_jaccard(t, t[: len(t) - half] + after[:half]))


def test_near_classes_of_every_row(spark, query, docs):
    got = query("op5_fingerprints").set_index("doc_id")
    sets = {d: {f[i : i + 8] for i in range(0, len(f), 8)} for d, f in got.fingerprint.items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(o for s in sets[d] for o in held[s])
        for o, k in shared.items():
            if 100 * k >= 80 * (len(sets[d]) + len(sets[o]) - k):
                a, b = root(d), root(o)
                up[max(a, b)] = min(a, b)
        for s in sets[d]:
            held[s].append(d)
    classes = {r.doc_id: r.near_class for r in spotsigs.near_classes(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    assert classes == {d: root(d) for d in sets} and sum(c != d for d, c in classes.items()) > 20


@pytest.mark.parametrize("group_rows", [3, 2000])
def test_next_of_any_ids(spark, monkeypatch, group_rows):
    """Ids at both ends of the range, one far from the others, none, and equal ones."""
    monkeypatch.setattr(spotsigs, "GROUP_ROWS", group_rows)
    ids = [-9 * 10**18, 9 * 10**18, *range(40), 2**60, None, None, None, 7, 7]
    rows = [(d, f"the word{i} and other{i} of some text{i} " * 3) for i, d in enumerate(ids)]
    got = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    order = sorted({d for d in ids if d is not None})
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add(t)
    for r in got:
        if r.doc_id is None or r.doc_id == 7:
            continue
        below = [d for d in order if d < r.doc_id]
        nexts = texts[below[-1]] if below else texts[None]
        own = next(iter(texts[r.doc_id]))
        made = {hashlib.sha256((own[: len(own) - len(own) // 2] + n[: len(own) // 2]).encode()).hexdigest() for n in nexts}
        assert r.edited_sha256 in made


def test_near_pairs_of_fingerprints(spark):
    rng = np.random.default_rng(7)
    words = ["the" if i % 3 == 0 else f"w{rng.integers(0, 5000)}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words[:290], "the", "new", "end"]), " ".join(words), "the other text of no relation at all"]
    got = spotsigs.near_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.a, r.b, r.n_a, r.n_b) for r in got] == [(0, 1, 2, 1)] and got[0].likeness >= 0.8


# Jaccard join


def plain_components(texts: dict[int, str], width=4, percent=85):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = set(zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for d in sets:
        shared = Counter(o for s in sets[d] for o in held[s])
        for o, k in shared.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[o]) - k):
                a, b = root(d), root(o)
                up[max(a, b)] = min(a, b)
        for s in sets[d]:
            held[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_join_whole_table(query, docs):
    got = query("op6_ngram_jaccard_join").set_index("doc_id")
    expected = plain_components(dict(zip(docs.doc_id, docs.text, strict=True)))
    assert {d: tuple(r) for d, r in zip(got.index, got[["n_shingles", "component_id"]].itertuples(index=False), strict=True)} == expected


@pytest.mark.parametrize("few", [0, 10_000])
def test_join_of_a_large_group(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(150):
        words = list(base)
        for i in rng.choice(120, rng.integers(0, 9), replace=False):
            words[i] = f"n{d}x{i}"
        texts[d] = " ".join(words)
    texts |= {200: "one two", 201: "One  TWO", 202: "", 203: None, 204: "a b c d", 205: "a b c d", 206: "é É É É"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_components(texts)


def copies_of_one_page(rng, n):
    """Texts of a few words each around a common page: near copies, far copies and a long one."""
    page = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(n):
        words = list(page)
        for i in rng.choice(120, rng.integers(0, 12), replace=False):
            words[i] = f"n{d}x{i}"
        texts[d] = " ".join(words)
    return texts | {n: " ".join(page * 40 + [f"z{i}" for i in range(3000)])} | {n + 1 + i: texts[i] for i in range(30)}


@pytest.mark.parametrize("part_rows", [4, 30])
def test_hot_columns_and_classes_are_split(spark, monkeypatch, part_rows):
    """Parts of hot columns, and classes given back by broadcast, lose no link."""
    monkeypatch.setattr(linking, "PART_ROWS", part_rows)
    texts = copies_of_one_page(np.random.default_rng(12), 120) | {500 + i: f"a b c d e f g h k{i}" for i in range(40)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_components(texts)


def test_columns_cost_no_more_for_a_larger_corpus():
    """A block's columns are counted in memory of its own size, however many bits their hashes have."""
    frame = pd.DataFrame({"text": list(copies_of_one_page(np.random.default_rng(13), 50).values())})
    few, many = (jaccard.Rows(frame, jaccard.WordHashes(), 4, bits) for bits in (24, 60))
    assert few.own[0].sum() == many.own[0].sum() and len(few.keys[0]) == pytest.approx(len(many.keys[0]), rel=0.01)
    assert many.keys[0].nbytes + many.own[0].nbytes + many.at.nbytes < 40 * frame["text"].str.len().sum()


def test_size_bands_hold_all_links():
    sizes = np.arange(1, 3000)
    for percent in (80, 85):
        band = np.floor(np.log(sizes) / (-1.001 * math.log(percent / 100))).astype(int)
        for n in sizes[:2000]:
            linked = sizes[(sizes >= n) & (100 * n >= percent * sizes)]
            assert (band[linked - 1] - band[n - 1] <= 1).all()


def test_components_by_stars(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    expected = {x: root(x) for p in pairs for x in p if p[0] != p[1]}
    edges = spark.createDataFrame(pairs, "a long, b long")
    for few in (0, 10_000):
        got = {r.id: r.component for r in components.components(edges, few).collect()}
        assert {x: got.get(x, x) for x in expected} == expected


# Language model


def plain_automaton(texts, train):
    """A walk function over an automaton of dictionaries, and the counts (words, N, V) of the training texts."""
    tokens = {d: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s> "] for d, t in texts.items()}
    grams = Counter()
    for d, w in tokens.items():
        if train(d):
            history = ("<s> ",)
            grams[history] += 1
            for t in w:
                for n in range(len(history) + 1):
                    grams[(*history[n:], t)] += 1
                history = (*history, t)[-2:]
    n = sum(c for g, c in grams.items() if len(g) == 1 and g[0] != "<s> ")
    v = sum(1 for g in grams if len(g) == 1 and g[0] != "<s> ")

    def failure(history):
        first, fall, least = language.FAILURE[len(history) - 1]
        return max(least, first - fall * math.log2(grams[history])) if grams[history] else 1.0

    def p(history, t):
        if not history:
            return (grams[t,] + 1) / (n + v + 1)
        weight = failure(history)
        return (1 - weight) * grams[(*history, t)] / max(grams[history], 1) + weight * p(history[1:], t)

    def walk(d):
        state, log = ("<s> ",) if grams["<s> ",] else (), 0.0
        for t in tokens[d]:
            while state and not grams[(*state, t)]:  # no arc
                log += math.log10(failure(state))
                state = state[1:]
            log += math.log10(p(state, t))
            state = (*state, t)[-2:]
            while state and not grams[state]:  # no such state
                state = state[1:]
        return log

    return tokens, grams, n, v, p, walk


def test_scores_whole_table(query, docs):
    got = query("op8_lm_scoring").set_index("doc_id")
    train = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    tokens, grams, n, v, p, walk = plain_automaton(dict(zip(docs.doc_id, docs.text, strict=True)), train)
    for d, w in tokens.items():
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(grams[t,] > 0 for t in w), n, not train(d))
        assert r.base_score == pytest.approx(sum(math.log10(p((), t)) for t in w)) and r.score == pytest.approx(walk(d))
    held = got[got.held_out]
    assert held.score.sum() > 0.85 * held.base_score.sum()


def test_next_word_probabilities_add_up(spark):
    texts = ["a b a c", "b b", "c a", "a b c"]
    vocabulary = ["a", "b", "c", "zz"]
    rows = dict(enumerate(texts)) | {10 + i: f"a b {w}" for i, w in enumerate(vocabulary)} | {20: "a b"}
    out = language.score_language(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), F.col("doc_id") < 10).toPandas().set_index("doc_id")
    *_, p, walk = plain_automaton(rows, lambda d: d < 10)
    for d in rows:
        assert out.score[d] == pytest.approx(walk(d))
    for history in ((), ("a",), ("a", "b"), ("<s> ",), ("<s> ", "a")):
        assert sum(p(history, t) for t in [*vocabulary, "</s> "]) == pytest.approx(1)


def test_blocks_and_ranges_change_nothing(spark, docs, monkeypatch):
    """Many small blocks and ranges, over several files, give the scores of one block."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300").repartition(3)
    score = lambda: {r.doc_id: r for r in language.score_language(frame, F.col("doc_id") % 3 != 0).collect()}
    whole = score()
    monkeypatch.setattr(counting, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(counting, "STRETCH_ROWS", 17)
    for d, r in score().items():
        assert r[:5] == whole[d][:5] and r.base_score == pytest.approx(whole[d].base_score) and r.score == pytest.approx(whole[d].score)


def test_long_texts_are_walked_in_stretches(docs, monkeypatch):
    rows = docs[["text"]].head(200).assign(train=[i % 4 > 0 for i in range(200)])
    grams = language.NGrams(rows, language.WordHashes())
    total = int(grams.own[0].sum())
    automaton = language.Automaton(grams, grams.own, total, 1000)
    whole = automaton.score(grams)
    for walk in (1, 2, 3, 50, 1 << 30):
        monkeypatch.setattr(language, "WALK", walk)
        assert automaton.score(grams) == pytest.approx(whole)


def test_block_rows_stay_in_proportion_to_the_corpus():
    rows = lambda size: (size / counting.Corpus(None, 0, size).block) * counting.Corpus(None, 0, size).ranges()
    assert [rows(100 * size) / rows(size) for size in (10**10, 10**12)] == pytest.approx([100, 100], rel=0.01)


# Packing


def test_pieces_and_sequences(query, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    expected = set()
    for d, e in zip(docs.doc_id, tokenizer.encode_batch(list(docs.text), add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            end = start + (2048 if start or len(ids) % 2048 == 0 else len(ids) % 2048)
            expected.add((d, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, piece = end, piece + 1
    got = query("op9_packing")
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == expected and len(got) == len(expected)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    sums = ordered.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and len(sums) <= math.ceil(got.length.sum() / 2048) * 1.01 + 1


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "don't  stop\n\n\t x", "１２³½ Ⅷ é́    z\x1c", "日本語 テキスト 🙂🙂", "a" * 3000, " " * 500 + "x", "'s'ts'll"])
def test_ids_are_those_of_the_tokenizer(text):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    assert packing.encoder(public.path("byte_bpe_50k.json"))(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a b" + " " * 2_000_000 + "c d", "\n" * 2_000_000, "x" + "\n" * 1_000_001 + " " * 600_000 + "\u3000y z " + "\t" * 1_200_000, "a" * 2_000_000])
def test_ids_of_very_long_runs(text):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("special", [False, True])
def test_added_tokens_are_text_or_their_ids(special):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = not special
    encode = packing.encoder(public.path("byte_bpe_50k.json"), special)
    for text in ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "no\n<|endoftext|", " " * 600_000 + "<|endoftext|>" + " " * 600_000]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_edges_of_packing(edge):
    """Null and empty texts are one id, very long ones are cut, equal rows and null ids are packed each, columns
    of any name do no harm, and an empty table gives no rows; so with the stage."""
    import corpus_pipeline as pipeline

    pytest.importorskip("public_tokenizers")
    for out in (packing.pack(edge), dict(pipeline.STAGES)["sequences"](edge.sparkSession, edge, FOLDER)):
        got = out.withColumn("doc_id", F.col("doc_id").cast("string")).toPandas()
        assert Counter(d and int(d) for d in got[got.piece == 0].doc_id) == Counter([1, 1, 2, None, 9007199254740993, 4, 5, 6, 7])
        assert got[got.doc_id.isin(["2", "4"])].length.tolist() == [1, 1] and (got[got.doc_id == "6"].length.sum(), got[got.doc_id == "6"].length.max()) == (30002, 2048)
        ordered = got.sort_values(["sequence_id", "offset"])
        assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all() and ordered.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(edge.limit(0)).count() == 0


def test_supersteps_are_best_fit():
    rng = np.random.default_rng(10)
    for _ in range(20):
        lengths = rng.integers(1, 101, 300).tolist()
        gaps = []
        for n in sorted(lengths, reverse=True):  # one at a time
            fit = min((g for g in gaps if g >= n), default=None)
            gaps.append((100 if fit is None else fit) - n)
            if fit is not None:
                gaps.remove(fit)
        runs = packing.supersteps(Counter(lengths), 100)
        held, placed = Counter(), Counter()
        for r in runs:
            placed[r.length] += r.high - r.low
            for rank in range(r.low, r.high):
                held[r.first + (rank - r.low) // r.per] += r.length
        assert placed == Counter(lengths) and max(held.values()) <= 100 and len(held) == len(gaps)


# Rules


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(query, docs, edge):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = query("op10_quality_rules").set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        expected = plain_counts(t)
        assert tuple(got.loc[d, names]) == expected
        assert got.base_failed[d] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
    assert not got.kept[got.base_failed].any()
    more = ["a a a a a", "x y z x y z", "l\nl\n \nl", "\x1c\x1d a", " ", "a b #*"]
    frame = edge.sparkSession.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    for r in rules.base_counts(frame).collect():
        assert tuple(r[n] for n in names) == plain_counts(more[r.doc_id])


def test_verdicts_follow_quality(query):
    got = query("op10_quality_rules").merge(pd.read_parquet(f"{FOLDER}/labels.parquet"), on="doc_id")
    long = got[~got.base_failed]
    assert long[long.quality == 1].kept.mean() > 0.99 and long[long.quality == 0].kept.mean() < 0.05


def test_verdicts_of_a_plain_ratio(spark, query, docs):
    """Hashes, counts, ratios and verdicts of every row, in plain Python."""
    import regex

    token = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0B\f\r]+")

    def grams(text):
        h = [spark_hash(t) for t in token.findall(text or "")]
        return [x % rules.BUCKETS for x in h] + [spark_hash(x, y) % rules.BUCKETS for x, y in zip(h, h[1:], strict=False)]

    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    good, held = set(labels[labels.quality == 1].doc_id), {d: grams(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    raw, target = Counter(b for g in held.values() for b in g), Counter(b for d, g in held.items() if d in good for b in g)
    more = lambda c: rules.SMOOTHING * sum(c.values()) / rules.BUCKETS
    extra, n_raw, n_target = (more(target), more(raw)), sum(raw.values()), sum(target.values())
    ratio = {b: math.log((target[b] + extra[0]) / (n_target + rules.BUCKETS * extra[0]) / ((raw[b] + extra[1]) / (n_raw + rules.BUCKETS * extra[1]))) for b in raw}
    scored = {r.doc_id: r.llr for r in rules.judge(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")).select("doc_id", "llr").collect()}
    got = query("op10_quality_rules").set_index("doc_id")
    for d, g in held.items():
        mean = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert scored[d] == pytest.approx(mean, abs=1e-9)
        assert got.kept[d] == (not got.base_failed[d] and mean >= rules.THRESHOLD)


def test_ratios_by_hand(spark):
    docs = spark.createDataFrame([(1, "good good word"), (2, "bad !! word"), (3, None)], "doc_id long, text string")
    ratios = rules.log_ratios(docs, spark.createDataFrame([(1,)], "doc_id long"))
    scored = {r.doc_id: r.llr for r in rules.add_ratio(docs, ratios).collect()}
    assert scored[1] > 0 > scored[2] and scored[3] == 0
    raw = Counter(b for r in docs.select(rules.buckets(F.coalesce("text", F.lit(""))).alias("b")).collect() for b in r.b)
    target = Counter(docs.where("doc_id = 1").select(rules.buckets(F.col("text")).alias("b")).first().b)
    share = lambda c, b: (c[b] + rules.SMOOTHING * sum(c.values()) / rules.BUCKETS) / (sum(c.values()) * (1 + rules.SMOOTHING))
    for b in raw:
        assert ratios[b] == pytest.approx(math.log(share(target, b) / share(raw, b)))


# Registration and pipeline


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", n)[0] for n in names if re.match(r"op\d+_", n)} and "pipeline" in names


def test_pipeline_stage_by_stage(spark, docs):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "mixture", "sequences"]
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = frame.columns, dict(pipeline.STAGES)
    kept = stages["quality"](spark, frame, FOLDER).toPandas()
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    assert set(labels[labels.quality == 1].doc_id) - set(kept.doc_id) == set() and len(set(labels[labels.quality == 0].doc_id) & set(kept.doc_id)) <= 2
    single = stages["near_duplicates"](spark, spark.createDataFrame(kept), FOLDER).toPandas()
    expected = {c for d, (_, c) in plain_components(dict(zip(kept.doc_id, kept.text, strict=True)), 5, 80).items()}
    assert set(single.doc_id) == expected and list(single.columns) == columns
    cut = stages["repeated_strings"](spark, spark.createDataFrame(single), FOLDER).toPandas()
    single = single.sort_values("doc_id")
    gone = {d: r[1] for d, r in zip(single.doc_id, plain_removal(single.text), strict=True)}
    whole = cut.merge(single, on="doc_id", suffixes=("", "_in"))
    assert all((a == b) == (gone[d] == 0) for d, a, b in zip(whole.doc_id, whole.text, whole.text_in, strict=True)) and list(cut.columns) == columns
    mixed = stages["mixture"](spark, spark.createDataFrame(cut), FOLDER).toPandas()
    assert mixed.groupby("doc_id").size().max() <= 2 and list(mixed.columns) == columns
    packed = stages["sequences"](spark, spark.createDataFrame(mixed), FOLDER).toPandas()
    assert Counter(packed[packed.piece == 0].doc_id) == Counter(mixed.doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_repeated_strings_keeps_blank_rows(spark):
    import corpus_pipeline as pipeline

    rows = [(1, SENTENCE), (2, None), (3, ""), (4, " \n"), (5, SENTENCE), (6, "a word"), (7, None)]
    out = dict(pipeline.STAGES)["repeated_strings"](spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 6, 7} and {r.doc_id: r.text for r in out if r.doc_id in (2, 3, 4)} == {2: None, 3: "", 4: " \n"}


def test_pipeline_of_edges_and_of_nothing(spark, edge, tmp_path):
    import corpus_pipeline as pipeline

    pytest.importorskip("public_tokenizers")
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for name, docs in {"edges": edge, "nothing": edge.limit(0)}.items():
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = pipeline.run(spark, f"{tmp_path}/{name}").toPandas()
        assert (len(out) > 0) == (name == "edges") and set(out.doc_id.dropna().astype(int)) <= {1, 2, 4, 5, 6, 9007199254740993, 7}


def test_pipeline_runs_whole(spark):
    import corpus_pipeline as pipeline

    out = pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 2048
