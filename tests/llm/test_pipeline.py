import pytest

import corpus_pipeline
from quernstone.llm import decontamination, pii, quality
from quernstone.llm.common import KEY, KEY_SETTING, scratch_root, surrogate_key, written
from tests.llm.fixtures import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def test_columns_stay(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_what_is_labelled_good(spark, steps):
    before, after = steps["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert after.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * before.join(labels.where("quality = 1"), "doc_id").count()
    assert after.join(labels.where("quality = 0"), "doc_id").count() <= 0.2 * max(1, before.join(labels.where("quality = 0"), "doc_id").count())


def test_one_document_of_each_group(steps):
    before, after = steps["near_duplicates"]
    want = brute_components([tuple(r) for r in before.select("doc_id", "text").collect()], 5, 80, 100)
    assert {r[0] for r in after.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_contaminated_documents_go(spark, steps):
    before, after = steps["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {r["doc_id"] for r in decontamination.find_contamination(before, bench).where("contaminated").collect()}
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()} - found


def test_personal_data_is_replaced(steps):
    before, after = steps["personal_data"]
    new = {r["doc_id"]: r["text"] for r in after.collect()}
    cipher = pii.Cipher(KEY)
    for r in before.collect():
        assert new[r["doc_id"]] == pii.rewrite(r["text"], cipher)[0]


def test_every_token_is_packed_once(steps):
    before, after = steps["packing"]
    total = after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "a", "b")
    assert total.count() == before.count() and total.where("a <> b").count() == 0


def test_personal_data_stage_checks_collisions(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a.b@x.org"), (2, "b.a@x.org")], "doc_id long, text string")
    monkeypatch.setattr("quernstone.llm.pii.check_collisions", lambda docs, key: (_ for _ in ()).throw(ValueError("collide")))
    with pytest.raises(ValueError, match="collide"):
        corpus_pipeline.replace_personal_data(spark, docs, "")


ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n ", "en", None, 3), (4, "one word", "de", "a", 8), (None, "Mail a.b@x.org, please.", "en", "a", 23),
    (5, "Some plain words, in a line of prose. " * 3000, "en", "a", 1), (6, "Some plain words, in a line of prose. " * 3000, "en", "a", 1), (4, "one word", "de", "a", 8),
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with labels and benchmark, and documents of every odd case with clashing names."""
    root = str(tmp_path_factory.mktemp("odd"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    bench = [(1, "windows of ten words that stand in no document of this small test"), (None, "one word"), (3, None), (4, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, stats string, gone int, __data double")
    return root, docs


def counted(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, small, name, stage):
    root, docs = small
    if name == "quality":  # its labels are of other documents: fitted there, applied to these
        root = SF
    after = stage(spark, docs, root)
    empty = stage(spark, docs.limit(0), root)
    assert empty.count() == 0 and empty.columns == after.columns
    if name != "packing":
        assert after.columns == docs.columns
    rows = after.collect()
    if name == "near_duplicates":
        assert sorted(map(str, after.drop("__data").collect())) == sorted(map(str, docs.where("doc_id IS NULL OR doc_id <> 6").drop("__data").collect()))
    elif name == "decontamination":
        assert counted(after) == counted(docs)
    elif name == "personal_data":
        assert len(rows) == len(ROWS) and [r["n_chars"] for r in rows if r["doc_id"] == 1] == [None]
        assert all("a.b@x.org" not in (r["text"] or "") for r in rows) and {r["text"] for r in rows if r["doc_id"] in (5, 6)} == {ROWS[5][1]}
    elif name == "packing":
        whole = {}
        for r in rows:
            whole.setdefault(r["doc_id"], []).append(r["length"])
        assert whole[1] == [1] and whole[2] == [1] and whole[3] == [1] and len(whole[4]) == 2 and sum(whole[5]) == sum(whole[6]) > 4096
    else:
        assert {str(r) for r in rows} <= {str(r) for r in docs.collect()}


def test_quality_without_labels_of_both_kinds(spark, small):
    _, docs = small
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for kind, n in (("FALSE", len(ROWS)), ("quality = 1", len(ROWS)), ("quality = 0", 0)):
        model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels.where(kind))
        assert quality.keep_good(docs, model).count() == n


def test_key_of_a_setting(spark):
    text = spark.createDataFrame([(1, "a.b@x.org")], "doc_id long, text string")
    public = corpus_pipeline.replace_personal_data(spark, text, "").first()["text"]
    try:
        spark.conf.set(KEY_SETTING, "a secret")
        secret = corpus_pipeline.replace_personal_data(spark, text, "").first()["text"]
        spark.conf.set(KEY_SETTING, "")
        with pytest.raises(ValueError, match="empty"):
            surrogate_key(spark)
    finally:
        spark.conf.unset(KEY_SETTING)
    assert len({public, secret, "a.b@x.org"}) == 3


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Away:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Away)
