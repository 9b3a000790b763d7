import numpy as np
import pytest
from pages import nodes_of
from pyspark.sql import functions as F

from pagemill.functions.vectors import cosine_similarity, mean_pool
from pagemill.operators import media as M
from pagemill.operators.embed import embed_documents, similar_pairs

URL = "http://h.com/d/p.html"
ROOT, REL = "http://h.com", "http://h.com/d/p.html"


def urls(media):
    return [(r.media_type, r.url) for r in media.orderBy("page_id", "seq").collect()]


def test_images(spark):
    html = (
        '<img src="/a.png" data-src="/no.png"><img src="" data-src="b.png" srcset="/c.png 1x, d.png 2x ,, /e.png">'
        "<img><img src='/a.png'>"
    )
    want = [ROOT + "/a.png", REL + "b.png", ROOT + "/c.png", REL + "d.png", ROOT + "/e.png", ROOT + "/a.png"]
    assert urls(M.extract_images(nodes_of(spark, html, url=URL))) == [("image", u) for u in want]


def test_nested_pictures_and_sources(spark):
    html = (
        "<picture><source srcset='/1 2x, /2'><picture><source srcset=' , /3'><source src=x></picture></picture>"
        "<video src=/v><source src=/w></video><audio><source src=/s></audio>"
    )
    nodes = nodes_of(spark, html, url=URL)
    # the inner picture's sources belong to both; an empty first entry is the page itself
    assert urls(M.extract_picture_sources(nodes)) == [("image", u) for u in (ROOT + "/1", REL, REL)]
    assert urls(M.extract_videos(nodes)) == [("video", ROOT + "/v"), ("video", ROOT + "/w")]
    assert urls(M.extract_audio(nodes)) == [("audio", ROOT + "/s")]
    assert [u for _, u in urls(M.extract_media(nodes))] == [ROOT + "/1", REL, REL, ROOT + "/v", ROOT + "/w", ROOT + "/s"]


def test_main_content_is_chosen_on_the_uncut_page(spark):
    nodes = nodes_of(
        spark,
        "<body><nav><img src=/n></nav><img src=/b></body>",
        "<body><img src=/out><article><img src=/in></article></body>",
        "<body><nav><main><img src=/m></main></nav></body>",
        url=URL,
    )
    assert [u for _, u in urls(M.extract_media(nodes, ["images"]))] == [ROOT + u for u in ("/n", "/b", "/in", "/m")]


def test_types_counts_and_seed_base(spark):
    nodes = nodes_of(spark, "<img src=i><video src=v></video><audio src=a></audio>", "<p>", url=URL)
    assert M.extract_media(nodes, []).count() == 0
    assert [t for t, _ in urls(M.extract_media(nodes, ["videos", "audio"]))] == ["video", "audio"]
    assert M.media_counts(M.extract_media(nodes)).collect()[0][1:] == (1, 1, 1)
    assert urls(M.extract_media(nodes, ["images"], "http://seed/s"))[0][1] == "http://seed/si"


def test_manifest(spark):
    rows = [
        (0, 0, "image", "http://h/a/x.png?v=1"), (0, 1, "image", "http://o/b/x.png"), (1, 0, "video", "http://h/x.png"),
        (1, 1, "audio", "http://h/.htaccess"), (1, 2, "audio", "http://h/x."), (1, 3, "audio", "http://h/"),
        (1, 4, "image", "http://h/noext"), (1, 5, "image", "http://h/a.b/c.tar.gz/"),
    ]
    media = spark.createDataFrame(rows, "page_id long, seq int, media_type string, url string")
    assert {r.local_path: r.url for r in M.media_manifest(media).collect()} == {
        "images/x.png": "http://o/b/x.png",
        "videos/x.png": "http://h/x.png",
        "images/c.tar.gz": "http://h/a.b/c.tar.gz/",
    }


def test_cosine_and_pooling(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [-1.0, -2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>"
    )
    assert [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, -1.0, 0.0])
    tokens = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<float>>, m array<int>")
    assert tokens.select(mean_pool(F.col("t"), F.col("m"))).first()[0] == [2.0, 3.0]
    with pytest.raises(Exception, match="all zeros"):
        tokens.select(mean_pool(F.col("t"), F.array(F.lit(0), F.lit(0), F.lit(0)))).collect()


def test_embed_with_model_and_without(spark):
    df = spark.createDataFrame([(i, f"w{i} " * (i + 1) + "Same same") for i in range(20)], "i int, text string")

    def factory():
        def model(texts, max_length):
            width = max(len(t.split()) for t in texts)
            mask = np.array([[1] * len(t.split()) + [0] * (width - len(t.split())) for t in texts])
            tokens = np.array([[[float(len(w)), 1.0] for w in t.split()] + [[99.0, 99.0]] * (width - len(t.split())) for t in texts])
            return tokens, mask

        return model

    got = {r.i: r.embedding for r in embed_documents(df, factory, batch_size=7).collect()}
    for i, text in enumerate(r.text for r in df.orderBy("i").collect()):
        words = text.split()
        assert got[i] == pytest.approx([sum(map(len, words)) / len(words), 1.0])
    from collections import Counter

    import hashlib

    for row in embed_documents(df, dimensions=32).collect():
        counts = np.zeros(32)
        for word, n in Counter(row.text.lower().split()).items():
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 32] += n
        assert row.embedding == pytest.approx(list(counts / np.linalg.norm(counts)))


def test_hashed_words_are_counted_once_for_all_dimensions(spark):
    import hashlib

    texts = [None, "", "...", "É é_1 日本 日本 a-b", "w " * 5000 + " ".join(f"x{i}" for i in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(1)
    found = embed_documents(df, dimensions=5000)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # no filter for each dimension
    words = [[], [], [], ["é", "é_1", "日本", "日本", "a", "b"], ["w"] * 5000 + [f"x{i}" for i in range(5000)]]
    for row in found.collect():
        counts = np.zeros(5000)
        for word in words[row.i]:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 5000] += 1
        assert row.embedding == pytest.approx(list(counts / max(np.linalg.norm(counts), 1e-9)))
    assert embed_documents(df.where("i < 0"), dimensions=8).collect() == []


def test_model_reads_whole_texts(spark):
    texts = ["a " * 10 + "bbbb " * 300, "a" * 50, "a bb", "abcdef " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")

    def factory():
        def model(texts, max_length):  # a token is two characters of a word; it cuts at max_length
            pieces = [[w[i : i + 2] for w in t.split() for i in range(0, len(w), 2)][:max_length] for t in texts]
            width = max(map(len, pieces))
            mask = np.array([[1] * len(p) + [0] * (width - len(p)) for p in pieces])
            return np.array([[[float(x.count("b")), 1.0] for x in p] + [[9.0, 9.0]] * (width - len(p)) for p in pieces]), mask

        return model

    got = {r.i: r.embedding for r in embed_documents(df, factory, max_length=8, batch_size=3).collect()}
    assert got[0] == pytest.approx([1200 / 610, 1.0])
    assert got[1] == pytest.approx([0.0, 1.0])
    assert got[2] == pytest.approx([1.0, 1.0])
    assert got[3] == pytest.approx([1 / 3, 1.0])
    first = embed_documents(df, factory, max_length=8, single_window=True).orderBy("i").first()
    assert first.embedding == pytest.approx([0.0, 1.0])


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8))
    vectors[17] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    pairs = spark.range(900).select((F.col("id") % 70).alias("left_id"), (F.col("id") * 7 % 61).alias("right_id"))
    rows = similar_pairs(pairs, df).collect()
    assert len(rows) == 900
    for r in rows:
        if max(r.left_id, r.right_id) >= 60:
            assert r.similarity is None
        else:
            a, b = vectors[r.left_id], vectors[r.right_id]
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            assert r.similarity == pytest.approx(a @ b / norm if norm else 0.0)
