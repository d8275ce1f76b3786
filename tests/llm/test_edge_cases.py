"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from tallystone.llm import common, decontamination, line_dedup, mixing, mtree, secrets, sharding, simhash, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 50_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (3, "", "en", "s", 0), (4, LONG, "en", None, len(LONG)), (None, "x y z", "en", "s", 5), (5, "a b c d e f g", "en", "t", 13), (6, " \n\t ", "en", "s", 4)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("mine"), "shard": F.lit("mine"), "n_lines": F.lit("mine"), "copy": F.lit("mine")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [-1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    got = {}
    for r in mtree.top_k(df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    same = 1024 * 1024 + 512 * 512
    assert got == {0: [(1, same), (100, same), (7, 0)], 100: [(0, same), (1, same), (7, 0)]}
    assert mtree.top_k(df.limit(0)).count() == 0
    assert mtree.top_k(df.filter("vec_id = 0")).count() == 0


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[5] == {1} and by[2] == by[3] == by[6] == {2} and by[4] == {4}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [1, 2, 4]
    assert simhash.keep_first(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "c d e"), (2, None), (None, "a b"), (3, "!!"), (4, "zz " * 20)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.decontaminate(docs, items, columns=("score",)).collect()}
    assert rows[1].n_hit == 3 and rows[1].items == ["1"] and rows[1].clean_text == "a b   f g" and rows[1].score == "mine"
    assert rows[2].n_words == 0 and rows[2].clean_text is None and rows[4].n_words == 50_000
    assert decontamination.decontaminate(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.decontaminate(empty, items).count() == 0
    parts = decontamination.decontaminate(docs, items, shard_bytes=10)
    assert {(r.doc_id, r.n_hit) for r in parts.collect()} == {(r.doc_id, r.n_hit) for r in decontamination.decontaminate(docs, items).collect()}


def test_lines(spark, docs, empty):
    out = line_dedup.clean(docs)
    assert out.count() == docs.count() and {r.n_removed for r in out.collect()} == {0}
    many = spark.createDataFrame([(i, f"own line {i}\n same line \n\nlast", f"site{i % 9}") for i in range(40)], "doc_id long, text string, source string")
    got = line_dedup.clean(many.unionByName(spark.createDataFrame([(99, None, None)], many.schema))).collect()
    assert {r.text for r in got if r.doc_id < 40} == {f"own line {i}\n" for i in range(40)} and {r.n_removed for r in got if r.doc_id < 40} == {2}
    few = spark.createDataFrame([(i, f"x\nshared by five {i % 5}", f"site{i // 5}") for i in range(25)], many.schema)
    assert {r.text for r in line_dedup.clean(few, min_sites=6).collect()} == {f"x\nshared by five {k}" for k in range(5)}
    assert {r.text for r in line_dedup.clean(few, min_sites=5).collect()} == {""}
    assert line_dedup.clean(empty).count() == 0


def test_secrets(spark, docs, empty):
    out = secrets.scan(docs)
    assert out.columns == [*docs.columns, "secrets"] and out.filter(F.size("secrets") > 0).count() == 0
    assert secrets.scan(empty).count() == 0
    texts = {1: "key Zk3xQ9vB7tR2mW8yLp4K", 2: "123e4567-e89b-12d3-a456-426614174000", 3: "😀 token = 'abc-12345' x", 4: "token=ab; token: 1234567", 5: "AKIA" + "A" * 15 + " AKIA" + "B2" * 8, 6: "0123456789abcdef01234567z"}
    got = {r.doc_id: r.s for r in secrets.scan(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).select("doc_id", secrets.joined(F.col("secrets")).alias("s")).collect()}
    assert got == {1: "entropy:4:24", 2: "", 3: "assign:2:20", 4: "assign:10:24", 5: "access:20:40", 6: "hex:0:24"}


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.judged(docs, labels)
    assert out.count() == docs.count() and all(0 <= r.score_ <= 1 and r.score == "mine" for r in out.collect())
    assert toxicity.judged(empty, labels.limit(0)).count() == 0
    assert toxicity.folded("1DI0T Ｌоsеr a5 2024 $40 f@ke") == ["idiot", "ioser", "as", "2024", "40", "fake"]


def test_tokens(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    assert rows[2].n_tokens == 0 and rows[2].n_bytes == 0 and rows[3].n_tokens == 0 and rows[4].over_limit
    assert token_counts.count_tokens(empty, path).count() == 0
    assert token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == docs.count()


def test_sharding(spark, docs, empty, tmp_path):
    out = sharding.shard(docs, str(tmp_path / "a"), max_rows=2)
    assert sorted(map(str, out.drop("shard_").collect())) == sorted(map(str, docs.collect())) and dict(out.dtypes)["shard_"] == "int"
    assert sharding.shard(empty, str(tmp_path / "b")).count() == 0


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?q", "ftp://net", "net/", None, "", "https://x.org#/fr/", "https://x.org/fr/", "https://u.de/p", "https://u.de/p", "https://notnet/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"listed": F.lit("mine"), "host": F.lit("mine")})
    listed = spark.createDataFrame([("u.de/p",), ("",), (None,), ("elsewhere",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("net", "", None, "allow")
    assert got[2] == got[3] == got[4] == ("", "", None, "allow") and got[5] == ("x.org", "", None, "allow") and got[6] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[7] == got[8] == ("u.de", "/p", None, "block") and got[9][2:] == (None, "allow")
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and {r.size for r in rows if r.doc_id in (2, 3, 6)} == {0}
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.curriculum(empty).count() == 0
    out = mixing.curriculum(docs)
    assert set(docs.columns) <= set(out.columns)


def test_secrets_with_slashes(spark):
    rnd = random.Random(3)
    key = lambda n: "".join(rnd.choices(string.ascii_letters + string.digits + "+/", k=n))
    keys = [key(n) for n in (88, 172, 344) for _ in range(40)]
    assert sum(k.count("/") >= 3 for k in keys) > 40
    token = "x7Kq9Zt2Lm4Vb8Nc1Rw5Yp3D"
    texts = [*(f"AccountKey: {k}" for k in keys), f"see /hooks/T0/B0/{token} now", f"/example/{token}", "/usr/local/share/articles/2024/my-title-10/page12", "aaaaaaaa1/" + token + "/2024-01-02"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [s for s in r.secrets if s.kind == "entropy"] for r in secrets.scan(rows).collect()}
    n = len(keys)
    assert [i for i in range(n) if not got[i]] == [] and got[n] and got[n + 1] and not got[n + 2] and got[n + 3]
    assert all(texts[i][s.start : s.end] in keys[i] for i in range(n) for s in got[i])


#: Names that the operators use inside or give to their results.
CLASHES = (
    "size before target o b part position copy copy_no passes t full left id at n weight source_size doc row gone gone_hashes row_of_gone n_lines n_removed h s line lines secrets base_spans score predicted n_words n_hit items spans "
    "dropped clean_text fp sid segs prefix group_id label node u v key file shard _row _gone _name _metadata text_ limit_o limit_t words"
).split()


@pytest.fixture(scope="module")
def clashing(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is null or doc_id != 4")
    return rows.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "decontamination", "mixing", "sharding", "lines", "secrets", "groups", "components", "tokens", "mix"])
def test_columns_of_any_name_pass(spark, clashing, tmp_path, name):
    import public_tokenizers

    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "c d e")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    other = {
        "lines": line_dedup.clean, "secrets": secrets.scan, "groups": simhash.similar_groups, "components": simhash.near_duplicates, "mix": mixing.mix,
        "tokens": lambda d: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
    }
    out = stages[name](spark, clashing, str(tmp_path)) if name in stages else other[name](clashing)
    rows = out.collect()
    assert rows
    if name in stages and name != "sharding":
        assert out.columns == clashing.columns
    if name in stages or name in ("lines", "secrets"):
        assert out.columns[: len(clashing.columns)] == clashing.columns
        for r in rows:
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHES), r


def test_large_ids_beside_nulls(spark):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "a b c"), (None, "a b c"), (big + 1, None)], "doc_id long, text string").coalesce(1)
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    items = spark.createDataFrame([(1, "zz")], "item_id long, text string")
    for out in (token_counts.count_tokens(docs, path), simhash.near_duplicates(docs), decontamination.decontaminate(docs, items), toxicity.scored(docs, toxicity.Lexicon({}, ()))):
        assert {r.doc_id for r in out.collect()} == {big, None, big + 1}


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    many = [(i, f"same\nown {i}", f"site{i}") for i in range(9)]
    rows = [*many, (0, "innocent\nsame", "site0"), (None, "same\nkept", "site1")]
    got = sorted(r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == sorted([*(f"own {i}" for i in range(9)), "innocent", "kept"])


def test_stages_on_empty_tables(spark, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, docs, tmp_path):
    """Nulls, blanks, repeats and a long text, through all stages one by one."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "c d e")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["toxicity"](spark, docs, str(tmp_path))) == [1, 1, 2, 3, 4, 5, 6, None]
    assert ids(stages["near_dedup"](spark, docs, str(tmp_path))) == [1, 2, 4, None]
    assert ids(stages["decontamination"](spark, docs, str(tmp_path))) == [1, 1, 2, 3, 4, 5, 6, None]
    assert set(ids(stages["mixing"](spark, docs, str(tmp_path)))) <= {1, 4, 5, None}
    assert ids(stages["sharding"](spark, docs, str(tmp_path))) == [1, 1, 2, 3, 4, 5, 6, None]


def test_lean_passes_batches_and_errors():
    def odd(batches):
        for x in batches:
            if x == 2:
                raise ValueError("two")
            yield x

    own = common.lean(odd)
    assert list(own(iter([]))) == [] and list(own(iter([1, 3]))) == [1, 3]
    with pytest.raises(ValueError, match="two"):
        list(own(iter([1, 2])))
