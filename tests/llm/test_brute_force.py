"""Each query against a plain version over whole small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallystone.llm import components, decontamination, line_dedup, mixing, mtree, queries, secrets, sharding, simhash, token_counts, toxicity, url_filter

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want, df = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, DIR)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_tree_finds_all():
    rng = np.random.default_rng(1)
    for n in (1, 3, 700, 6000):
        rows = np.floor(300 * rng.normal(size=(n, 6))).astype(np.int64)
        rows[n // 2 :] = rows[0] if n == 700 else rows[n // 2 :]
        tree = mtree.MTree(rows.astype(float))
        assert sorted(tree.order) == list(range(n))
        q = rng.normal(size=6) * 300
        d = np.sqrt(((rows - q) ** 2).sum(axis=1))[tree.order]
        best = [math.inf]

        def take(at):
            best[0] = min(best[0], d[at].min())
            return best[0]

        tree.search(q, take, math.inf)
        assert best[0] == d.min()


def test_bounds_avoid_distances(monkeypatch):
    """On points with structure most distances are never computed, below and above the pages."""
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(60, 1, 8)) * 50 + rng.normal(size=(60, 100, 8))).reshape(-1, 8)
    tree, seen = mtree.MTree(rows, leaf=16), []
    for q in rows[::300] + 0.1:
        d = np.sqrt(((rows - q) ** 2).sum(axis=1))
        held = []

        def take(at):
            run = tree.order[at]
            seen.append(len(run))
            held.extend(d[run].tolist())
            return sorted(held)[9] if len(held) >= 10 else math.inf

        tree.search(q, take, math.inf)
        assert sorted(held)[:10] == sorted(d.tolist())[:10]
    assert sum(seen) < 0.2 * 20 * len(rows)
    upper = mtree.Upper(rows[::10], 100)
    page, far = upper.pages(rows)
    assert far[:, 0].tolist() == mtree._distances(rows, upper.points[0]).tolist() and upper.depth > 2
    upper.cover({p: far[page == p].max(axis=0).tolist() for p in set(page.tolist())})
    visited = 0
    for q in rows[::300]:
        near = {p for p, _ in upper.reached(q, 3.0)}
        assert set(page[mtree._distances(rows, q) <= 3.0].tolist()) <= near
        visited += len(near)
    assert visited < 0.2 * 20 * len(upper.path)


def test_top_k_over_many_pages(spark, monkeypatch):
    """Small pages, rings and blocks, and one vector that a third of the rows have."""
    monkeypatch.setattr(mtree, "QUERIES", 3)
    rnd = random.Random(6)
    own = [[rnd.gauss(0, 1) + 3 * (i % 7) for _ in range(6)] for i in range(1500)]
    rows = [(i, own[0] if i % 3 == 0 else own[i]) for i in range(1500)] + [(100, own[5]), (100, own[8])]
    got = {}
    for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), part=40, pages=12, per_page=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = {}
    for i, q in whole:
        if i % 100 == 0:
            best = sorted((-sum(map(int.__mul__, q, v)), j) for j, v in whole if j != i)[:10]
            want.setdefault(i, []).extend((n, j, -s) for n, (s, j) in enumerate(best, 1))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()} and len(got[100]) == 30


def groups_of(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, texts):
    def plain(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {d: plain(t) for d, t in texts.items()}
    want = groups_of([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op2_simhash_dedup"](spark, DIR).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


@pytest.mark.parametrize("dense", [4, 48, 10_000])
def test_links_join_the_same(spark, dense):
    rnd = random.Random(dense)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) for b in base for _ in range(60)} | set(range(40))
    fps = sorted(x - (1 << 64) if x >> 63 else x & (1 << 64) - 1 for x in fps if x < 1 << 64)
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = groups_of([(a, b) for a in fps for b in fps if a < b and bits(a, b) <= 2], fps)
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), dense).collect()]
    assert all(bits(a, b) <= 2 for a, b in found) and groups_of(found, fps) == want


def test_near_copies_are_found(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    docs, n_near = {}, 0
    for g in range(30):
        w = [word() for _ in range(300)]
        docs[10 * g] = " ".join(w)
        docs[10 * g + 1] = " ".join(w).upper()  # the same but for case
        near = list(w)
        for i in rnd.sample(range(300), 3):
            near[i] = word()
        docs[10 * g + 2] = " ".join(near)
        docs[10 * g + 3] = " ".join(w[:150] + [word() for _ in range(150)])  # half of it: no copy
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(docs.items()), "doc_id int, text string")).collect()}
    assert {d for d in docs if d % 10 in (0, 3)} <= kept and not {d for d in docs if d % 10 == 1} & kept
    n_near = sum(d % 10 == 2 for d in kept)
    assert n_near <= 3
    crowd = {i: " ".join(["x"] * 5 + [f"w{k}" for k in range(300)] + [f"tail{i}"]) for i in range(400)}
    assert simhash.keep_first(spark.createDataFrame(list(crowd.items()), "doc_id int, text string")).count() == 1


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u int, v int"), few).collect()}
    pairs = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == {n: g for n, g in groups_of(pairs, {x for p in pairs for x in p}).items() if n != g}
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "u string, v string")
    assert {r.node: r.label for r in components.components(names, few).collect()} == {"b": "a", "c": "a", "z": "y"}
    assert components.components(names.limit(0), few).count() == 0


def test_decontamination(spark, texts):
    items = {r.item_id: decontamination.words(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op3_decontaminate"](spark, DIR).collect()}
    for d, t in texts.items():
        w = [x.lower().encode() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x).encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        hit, found = set(), set()
        at = {}
        for i in range(len(w) - 9):
            at.setdefault(tuple(w[i : i + 10]), []).append(i)
        for item, u in items.items():
            for k in range(len(u) - 9):
                for i in at.get(tuple(u[k : k + 10]), ()):
                    hit |= set(range(i, i + 10))
                    found.add(str(item))
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert got[d].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_automaton():
    rnd = random.Random(1)
    for _ in range(300):
        known = "a B c É d9".split()[: rnd.randint(1, 5)]
        window = rnd.choice([3, 4, 10])
        items = [(str(i), " ".join(rnd.choices(known, k=rnd.randint(0, 14)))) for i in range(rnd.randint(0, 6))]
        own = decontamination.Automaton(items, window)
        text = " ".join(rnd.choices([*known, "zz"], k=rnd.randint(0, 40)))
        w, hit, found = decontamination.words(text), set(), set()
        for i, t in items:
            u = decontamination.words(t)
            k = min(window, len(u))
            for a in range(len(u) - k + 1 if u else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == u[a : a + k]:
                        found.add(i)
                        hit |= set(range(p, p + k))
        spans, items_found = own.match(w)
        assert {x for a, b in spans for x in range(a, b)} == hit and items_found == found
        assert own.match(decontamination.words(decontamination.cut(text, [own])))[0] == []


def test_secrets(spark, texts):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.QUERIES["op5_secret_scan"](spark, DIR).collect():
        t = texts[r.doc_id] or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_toxicity_on_rows_never_seen(spark):
    rows = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("score", "toxic", "predicted").collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad) and sum(r.predicted for r in good) <= 0.02 * len(good)
    assert sum((b.score > g.score) + 0.5 * (b.score == g.score) for b in bad for g in good) >= 0.93 * len(bad) * len(good)


def test_folding_and_exceptions():
    own = toxicity.Lexicon({"idiot ": 3.0, "trash ": 2.0, "clow": 1.0}, ("trash can",))
    known = toxicity.Lexicon({k.replace("l", "i"): v for k, v in own.weights.items()}, own.exceptions)
    total = lambda t: round(math.expm1(known.features(known.automaton(), t)[0]), 6)
    assert total("An 1di0t!") == 3 and total("іdіоt") == 3 and total("a trash can") == 0 and total("trash canned") == 2 and total("clowns") == 1 and total("idiots") == 0


def test_tokens(spark, texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.QUERIES["op7_token_counts"](spark, DIR).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(model.encode(t))) and r.over_limit == (r.n_tokens > 4096)


def test_splicing(texts):
    import public_tokenizers

    coder = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(3)
    odd = ["".join(rnd.choices(" ab\n▁é☃  theing.\t漢", k=rnd.randint(60, 400))) for _ in range(150)]
    for t in [t for t in texts.values() if t and len(t) > 60][:60] + odd + ["x" * 3000, " " * 500, "a" + " " * 300 + "b" * 300]:
        whole = coder.whole([t])[0]
        assert coder.count(t) == whole and {token_counts.spliced(coder, t, c, o) for c, o in ((40, 5), (200, 20), (1000, 50))} == {whole}


def test_store(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000)
    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x"))
    for k in range(3):
        store.append(rows.filter(F.col("id") % 3 == k), max_rows=150)
    before = store.manifest()
    version = store.compact()
    assert version == before["version"] + 1
    while version != (version := store.compact()):
        pass
    after = store.manifest()
    assert len(after["shards"]) < len(before["shards"]) and not store.plan(after["shards"])
    assert max(s["bytes"] for s in after["shards"]) <= 1.2 * 60_000 and sum(s["rows"] for s in after["shards"]) == 3000
    assert sorted(store.read().select("id").collect()) == sorted(rows.select("id").collect()) == sorted(store.read(before["version"]).select("id").collect())
    with pytest.raises(sharding.ConflictError):
        store.commit(before, before["schema"], [])
    assert store.expire() and store.versions() == [version] and store.read().count() == 3000


def test_sharding_keeps_documents(spark, tmp_path):
    got = queries.QUERIES["op8_tiered_shards"](spark, DIR).drop("shard").collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = [(r.doc_id, r.lang, r.source, r.n_chars, len((r.text or "").encode())) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    out = sharding.shard(docs, str(tmp_path / "s"), max_rows=20)
    assert sorted(map(str, out.drop("shard").collect())) == sorted(map(str, docs.collect()))
    assert "hashpartitioning" not in out._jdf.queryExecution().toString()  # texts aren't moved to find their shards


def test_tiers(spark, tmp_path, monkeypatch):
    """Only shards of similar size are merged, and only if there are enough; whatever comes, few stay small."""
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=32 << 20)
    sized = lambda *sizes: [{"file": f"data/a-{i:04d}/part-{i}", "rows": 1, "bytes": n} for i, n in enumerate(sizes)]
    assert store.plan(sized(15_000_000, 200_000, 1_000)) == [] and store.plan(sized(*[1_000_000] * 3)) == []
    assert [len(r) for r in store.plan(sized(*[1_100_000] * 4, 15_000_000, *[2_000] * 5))] == [5, 4]
    rnd, live, written = random.Random(4), [], 0
    for k in range(300):
        live += [{"file": f"data/x-{k}-{i}/p", "rows": 1, "bytes": rnd.randint(1_000, 3_000_000)} for i in range(5)]
        while runs := store.plan(live):
            gone = {s["file"] for r in runs for s in r}
            made = [{"file": f"data/y-{k}-{len(live)}-{i}/p", "rows": 1, "bytes": sum(s["bytes"] for s in r)} for i, r in enumerate(runs)]
            assert all(s["bytes"] <= store.target for s in made)
            assert all(store.tier(max(s["bytes"] for s in r)) == store.tier(min(s["bytes"] for s in r)) for r in runs)
            written += sum(s["bytes"] for s in made)
            live = [s for s in live if s["file"] not in gone] + made
    total = sum(s["bytes"] for s in live)
    assert written <= 7 * total and sum(2 * s["bytes"] < store.target for s in live) <= 3 * 8
    monkeypatch.setattr(sharding, "PART_SHARDS", 3)
    for k in range(5):
        store.append(spark.range(10 * k, 10 * k + 10), max_rows=2)
    held = store.manifest()
    assert len(held["parts"]) >= 5 and sum(s["rows"] for s in held["shards"]) == 50
    one = held["shards"][0]
    store.commit(held, held["schema"], [], {one["file"]})
    assert len(set(store.manifest()["parts"]) & set(held["parts"])) == len(held["parts"]) - 1 and store.read().count() == 50 - one["rows"]


def test_cascade(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    levels, shards = url_filter.build_cascade(keys, shard_keys=700)
    assert shards == 6 and levels.agg(F.max("level")).first()[0] >= 2
    for send in (64, 0):  # sent to all, or met by shard
        rows = url_filter.apply_cascade(keys.withColumnRenamed("listed", "truth"), F.col("key"), levels, shards, send)
        assert rows.count() == 4000 and rows.filter("listed != truth").count() == 0
        twice = keys.unionByName(keys.limit(10)).withColumnsRenamed({"listed": "truth"}).withColumns({"h1": F.lit("mine"), "shard": F.lit(None).cast("long"), "piece": F.lit(2**62 + 1)})
        rows = url_filter.apply_cascade(twice, F.col("key"), levels, shards, send).select("key", "truth", "h1", "shard", "piece", "listed").collect()
        assert len(rows) == 4010 and all(r.truth == r.listed and r.h1 == "mine" and r.shard is None and r.piece == 2**62 + 1 for r in rows)


def test_mix(spark, texts):
    rows = queries.QUERIES["op10_curriculum_mix"](spark, DIR).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        s = source[r.doc_id]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = {s: 0.0 for s in sizes}
    left, free = 1.5 * sum(sizes.values()), set(sizes)
    while True:  # reshare what is above twice the size
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        free -= over
    want |= {s: level * weights[s] for s in free}
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) < 1 for s in sizes)
    again = queries.QUERIES["op10_curriculum_mix"](spark, DIR).collect()
    assert sorted(rows) == sorted(again)


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(900)], "doc_id int, text string, source string")
    out = mixing.curriculum(docs).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    early = lambda s: sum(r.position < 0.5 for r in out if r.source == s) / sum(r.source == s for r in out)
    assert abs(early("s0") - 0.6) < 0.03 and abs(early("s1") - 0.4) < 0.04 and abs(early("s2") - 0.5) < 0.03


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, DIR)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    own = decontamination.Automaton(items)
    assert not any(own.match(decontamination.words(r.text))[0] for r in kept.collect())
    final = corpus_pipeline.run(spark, DIR)
    assert final.columns == [*docs.columns, "shard"] and final.count() == kept.count()


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(docs):
    """The smallest id of each document's component of links with a Jaccard similarity of 0.8 at least."""
    sets, holds = {d: shingles(t) for d, t in docs.items()}, {}
    for d, s in sets.items():
        for x in s:
            holds.setdefault(x, set()).add(d)
    near = [(a, b) for a, s in sets.items() for b in set().union(*(holds[x] for x in s)) if a < b and 5 * len(s & sets[b]) >= 4 * len(s | sets[b])]
    return groups_of(near, docs)


def changed(rnd, words, n):
    """n words changed, apart from each other and from the ends: 5 n shingles of it."""
    out = list(words)
    for i in rnd.sample(range(5, len(words) - 5, 10), n):
        out[i] = f"new{rnd.getrandbits(40)}"
    return out


def fresh(rnd, n):
    return [f"w{rnd.getrandbits(40)}" for _ in range(n)]


def left(spark, docs):
    return {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(docs.items()), "doc_id int, text string")).collect()}


def test_chains_of_copies_go_whole(spark):
    """Each link of a chain is similar, its ends are not; big groups have members like texts that their smallest is not like."""
    rnd, docs = random.Random(1), {}
    for g in range(25):
        w = fresh(rnd, 304)
        for k in range(12):
            docs[1000 * g + (k * 7) % 12] = " ".join(w)
            w = changed(rnd, w, rnd.randint(1, 6))
    want = similar(docs)
    assert len(set(want.values())) == 25 and left(spark, docs) == set(want.values())


def test_crowded_templates_hide_no_copies(spark):
    """Unlike texts with a common passage crowd the buckets; the few copies among them are found, the others stay."""
    rnd, docs = random.Random(2), {}
    passage = fresh(rnd, 220)
    for g in range(150):
        w = passage + fresh(rnd, 80)
        docs[10 * g] = " ".join(w)
        if g % 3 == 0:
            docs[10 * g + 5] = " ".join(changed(rnd, w, rnd.randint(1, 5)))
    want = similar(docs)
    assert len(set(want.values())) == 150 and left(spark, docs) == set(want.values())


@pytest.mark.parametrize(("n", "least", "most"), [(300, 0.80, 0.85), (60, 0.80, 0.90), (300, 0.70, 0.80)])
def test_the_limit_is_exact(spark, n, least, most):
    """Pairs from 0.80 up are copies without a miss; pairs below stay, however near."""
    rnd, docs = random.Random(n + round(100 * least)), {}
    while len(docs) < 300:
        w = fresh(rnd, n + 4)
        k = next(k for k in rnd.sample(range(1, n // 10), n // 10 - 1) if least <= (n - 5 * k) / (n + 5 * k) < most)
        docs[len(docs)] = " ".join(w)
        docs[len(docs)] = " ".join(changed(rnd, w, k))
    want = similar(docs)
    assert len(set(want.values())) == (300 if most == 0.80 else 150) and left(spark, docs) == set(want.values())


@pytest.mark.parametrize("bucket_rows", [8, 4096])
def test_curriculum_takes_what_the_mix_takes(spark, monkeypatch, bucket_rows):
    """Whole documents: every source's words differ from its target by half its longest document at most."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, longest = {}, {}
    for r in mixing.mix(docs).collect():
        target[r.source], longest[r.source] = r.target, max(longest.get(r.source, 0), r.size)
    out, taken, times = mixing.curriculum(docs).collect(), {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
        times.setdefault(r.doc_id, []).append(r.copy)
    assert all(abs(taken.get(s, 0) - target[s]) <= longest[s] / 2 + 1 for s in target)
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 2 for c in times.values())
    assert [(r.position, r.doc_id) for r in out] == sorted((r.position, r.doc_id) for r in out) and all(0 <= r.position <= 1 for r in out)


def test_entropy_spans(spark):
    """The method's spans against windows whose characters are counted anew each time."""
    rnd = random.Random(8)
    alphabet = secrets.ALPHABET
    texts = []
    for _ in range(150):
        parts = ["".join(rnd.choices(rnd.choice([alphabet, alphabet[:36], "0123456789abcdef", "ab1"]), k=rnd.randint(5, 70))) for _ in range(rnd.randint(1, 6))]
        texts.append(rnd.choice([" ", " :", "é"]).join(parts))

    def entropy(w):
        return math.log2(len(w)) - sum(c * math.log2(c) for c in Counter(w).values()) / len(w)

    def spans(t):
        base = [m.span() for kind, p, g, least in secrets.KINDS for m in re.finditer(p, t, re.A) if len(m[g]) >= least]
        for c in re.finditer(secrets.CANDIDATE, t):
            for r in re.finditer(secrets.RUN, c[0]):
                s, at = r[0], c.start() + r.start()
                if len(s) < 20 or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or any(re.search(p, s) for p in secrets.ALLOW):
                    continue
                limit = next(v for p, v in secrets.CLASSES if re.search(p, s))
                hot = [i for i in range(len(s) - 19) if entropy(s[i : i + 20]) >= limit - 1e-9]
                if hot and not any(re.search(p, s[hot[0] : hot[-1] + 20]) for p in secrets.ALLOW_SPAN):
                    a, b = at + hot[0], at + hot[-1] + 20
                    if not any(x < b and a < y for x, y in base):
                        yield a, b

    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "entropy"] for r in rows}
    assert got == {i: list(spans(t)) for i, t in enumerate(texts)} and sum(map(len, got.values())) > 50


def test_groups_are_those_of_the_similarity(spark):
    """near_dedup over a whole table: its groups are the components of all pairs with a Jaccard similarity of 0.8 or more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = similar({r.doc_id: r.text or "" for r in docs.collect()})
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_items_in_shards(spark, texts):
    """Many small automata give what one gives, for marks and for cut texts."""
    docs, items = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda n: sorted(map(str, decontamination.decontaminate(docs, items, shard_bytes=n).drop("dropped").collect()))
    assert rows(4_000_000) == rows(20_000)


def test_mix_comes_in_training_order(spark):
    rows = [(r.first_position is not None, r.first_position or 0.0, r.doc_id) for r in queries.QUERIES["op10_curriculum_mix"](spark, DIR).collect()]
    assert rows == sorted(rows) and any(r[0] for r in rows)
