import io
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.operators import similarity
from mosaica.plans import dialect
from mosaica.plans.engine import Engine
from mosaica.sources import descriptors, media
from mosaica.sources.csv import read_csv
from mosaica.streaming.ingest import ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/root")


def people(engine):
    engine.sql("CREATE TABLE Personas (id INT KEY INDEX BTREE, nombre VARCHAR[5] INDEX BTREE, edad INT INDEX BTREE, date DATE INDEX ISAM)")
    engine.sql("INSERT INTO Personas (id, nombre, edad, date) VALUES (1, 'Alice', 30, '2024-01-01'), (2, 'Bobby T', 25, '2024-2-15')")
    engine.sql("INSERT INTO Personas VALUES (3, 'Ca''ro', 40, '2024-03-20');")


def names(df):
    return [r.nombre for r in df.collect()]


def test_rows(engine):
    people(engine)
    assert names(engine.sql("SELECT * FROM Personas WHERE id = 2")) == ["Bobby"]
    assert names(engine.sql("SELECT nombre FROM Personas WHERE edad BETWEEN 26.5 AND 45")) == ["Alice", "Ca'ro"]
    assert names(engine.sql("SELECT nombre FROM Personas WHERE edad BETWEEN 45 AND 26")) == []
    assert names(engine.sql("SELECT nombre FROM Personas WHERE nombre = 'Bobby T'")) == ["Bobby"]
    assert names(engine.sql("SELECT nombre FROM Personas WHERE date >= '2024-02-01' AND edad <> 40 LIMIT 5")) == ["Bobby"]
    assert engine.sql("DELETE FROM Personas") == {"deleted": 0}
    assert engine.sql("DELETE FROM Personas WHERE edad = 25") == {"deleted": 1}
    assert names(engine.sql("SELECT * FROM Personas LIMIT 1")) == ["Alice"] and engine.scan("Personas").count() == 2
    engine.catalog.lay_out("main", "Personas", "edad", 2)
    assert names(engine.sql("SELECT * FROM Personas")) == ["Alice", "Ca'ro"]
    assert engine.catalog.layout_stats("main", "Personas", "edad").agg(F.sum("rows")).first()[0] == 2
    assert engine.sql("INSERT INTO Personas (id) VALUES (9)") == {"inserted": 1}
    assert engine.collect("SELECT edad FROM Personas WHERE id = 9").rows == [{"edad": None}]
    for bad in ("SELECT x FROM Personas", "SELECT * FROM Nobody", "INSERT INTO Personas VALUES (1)", "INSERT INTO Personas (nombre) VALUES ('x')", "UPDATE x", "CREATE TABLE Personas (id INT)", "CREATE TABLE y (id INT) FROM FILE 'a'"):
        with pytest.raises(Exception):  # noqa: B017
            engine.collect(bad)
    assert engine.catalog.tables("main") == ["Personas"] and engine.catalog.drop_table("main", "Personas")


def test_alternatives(engine):
    people(engine)
    assert names(engine.sql("SELECT * FROM Personas WHERE id = 1 OR id = 3")) == ["Alice", "Ca'ro"]
    assert names(engine.sql("SELECT * FROM Personas WHERE NOT (id = 1 OR edad < 30) AND date >= '2024-01-01'")) == ["Ca'ro"]
    assert engine.sql("DELETE FROM Personas WHERE id = 1 OR nombre = 'Bobby'") == {"deleted": 2}
    with pytest.raises(dialect.SQLError):
        engine.sql("SELECT * FROM Personas WHERE nombre @@ 'x' OR id = 1")


def test_points(engine):
    engine.sql("CREATE TABLE Lugares (id INT KEY, coord ARRAY[FLOAT] INDEX RTREE, label VARCHAR[16])")
    engine.sql("INSERT INTO Lugares VALUES (1, [19.43, -99.13], 'A'), (2, [19.44, -99.14], 'B'), (3, '19.45, -99.12', 'C')")
    labels = lambda sql: [r.label for r in engine.sql(sql).collect()]
    assert labels("SELECT * FROM Lugares WHERE NEAR(coord, [19.44, -99.14]) RADIUS 0.02") == ["A", "B"]
    assert labels("SELECT * FROM Lugares WHERE KNN(coord, [19.44, -99.14]) K 2") == ["B", "A"]
    assert labels("SELECT label FROM Lugares WHERE coord = [19.45, -99.12]") == ["C"]
    with pytest.raises(Exception):  # noqa: B017
        engine.knn("Lugares", "coord", [1.0, 2.0, 3.0], 1).collect()


def test_boxes_reach_the_files(spark, engine):
    engine.sql("CREATE TABLE p (id INT KEY, spot ARRAY[FLOAT] INDEX RTREE)")
    engine.load("p", spark.range(2000).select("id", F.array((F.col("id") % 50).cast("double"), F.floor(F.col("id") / 50).cast("double")).alias("spot")))
    engine.catalog.lay_out("main", "p", "spot", 8)
    df = engine.sql("SELECT * FROM p WHERE NEAR(spot, [3, 4]) RADIUS 1")
    assert sorted(r.id for r in df.collect()) == [153, 202, 203, 204, 253] and df.columns == ["id", "spot"]
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(__spot_0,2.0)" in plan  # among the PushedFilters, which are cut short here
    assert engine.near("p", "spot", [3.0, 4.0], 1.0).columns == ["id", "spot"]


def test_text(engine):
    engine.sql("CREATE TABLE Docs USING INDEX btree(id), fulltext(title), fulltext(body)")
    engine.sql("INSERT INTO Docs VALUES (id=1, title='Amor', body='amor en tiempos de guerra'), (2, 'Paz', 'los tiempos'), (3, 'Nada', 'Ámores y guerras')")
    hits = engine.sql("SELECT id FROM Docs WHERE body @@ 'amor tiempos' LIMIT 5").collect()
    assert [r.id for r in hits] == [1, 2] and hits[0].score > hits[1].score > 0
    assert [r.id for r in engine.search("Docs", "body", "guerra tiempo").collect()] == [1]
    assert {r.id for r in engine.text_search("Docs", ["title", "body"], "amor paz").collect()} >= {1, 2}
    engine.sql("DELETE FROM Docs WHERE id = 1")
    assert [r.id for r in engine.sql("SELECT id FROM Docs WHERE body @@ 'tiempos'").collect()] == [2]


def test_csv(spark, tmp_path, engine):
    path = tmp_path / "a.csv"
    path.write_text("id,nombre,ubicacion\n1,Ana,[12.07, -77.05]\n-5,Luis,[1, 2]\n")
    kinds = {"id": "INT", "nombre": "VARCHAR", "ubicacion": "ARRAY", "more": "FLOAT"}
    rows = read_csv(spark, f"file://{path}", kinds).orderBy("id").collect()
    assert [(r.id, r.ubicacion, r.more) for r in rows] == [(-5, [1.0, 2.0], None), (1, [12.07, -77.05], None)]
    bad = tmp_path / "b.csv"
    bad.write_text("id;score\n3.14;x\nnull;2,5\n")
    lenient = read_csv(spark, f"file://{bad}", {"id": "INT", "score": "FLOAT"}, lenient=True).collect()
    assert sorted((r.id, r.score) for r in lenient) == [(0, 2.5), (314, 0.0)]
    with pytest.raises(Exception):  # noqa: B017
        read_csv(spark, f"file://{bad}", {"id": "INT", "score": "FLOAT"}).collect()


def test_csv_wherever_arrays_and_breaks_are(spark, tmp_path):
    path = tmp_path / "late.csv"
    lines = [f'{i},"[{i}, 2]"' for i in range(25)] + ["99,[3, 4]", "id,[5]", '100,"[6,', ' 7]"']
    path.write_text("id,v\n" + "\n".join(lines) + "\n")
    rows = {r.id: r.v for r in read_csv(spark, f"file://{path}", {"id": "VARCHAR", "v": "ARRAY"}).collect()}
    assert rows["99"] == [3.0, 4.0] and rows["3"] == [3.0, 2.0] and rows["id"] == [5.0] and rows["100"] == [6.0, 7.0] and len(rows) == 28
    split = {r.id for r in read_csv(spark, f"file://{path}", {"id": "VARCHAR"}, multiline=False).collect()}
    assert {"0", "99", "id"} <= split
    bad = tmp_path / "bad.csv"
    bad.write_text("id,v\n1,[1, x]\n")
    with pytest.raises(Exception):  # noqa: B017
        read_csv(spark, f"file://{bad}", {"id": "INT", "v": "ARRAY"}).collect()
    assert read_csv(spark, f"file://{bad}", {"id": "INT", "v": "ARRAY"}, lenient=True).first().v == [1.0]
    breaks = tmp_path / "breaks.csv"
    breaks.write_text('id,t\n1,"a\nb"\n\n2,c\n')
    assert sorted(map(tuple, read_csv(spark, f"file://{breaks}", {"id": "INT", "t": "VARCHAR"}).collect())) == [(1, "a\nb"), (2, "c")]


def test_words_of_any_script_find_themselves(engine):
    engine.sql("CREATE TABLE d (id INT KEY, body VARCHAR INDEX FULLTEXT)")
    words = ["tiếng việt", "άλφα βήτα", "йога", "łódź", "日本語", "żółć crème"]
    engine.load("d", engine.spark.createDataFrame(list(enumerate(words)), "id long, body string"))
    for i, w in enumerate(words):
        assert [r.id for r in engine.search("d", "body", w).collect()] == [i]
        assert [r.id for r in engine.sql(f"SELECT id FROM d WHERE body @@ '{w}'").collect()] == [i]


def test_index_is_written_once_and_pruned(spark, engine):
    engine.sql("CREATE TABLE d (id INT KEY, body VARCHAR INDEX FULLTEXT, lang VARCHAR)")
    engine.load("d", spark.range(400).select(F.col("id"), F.concat(F.lit("word "), F.when(F.col("id") % 7 == 0, F.lit("seven ")).otherwise(""), F.col("id").cast("string")).alias("body"), F.when(F.col("id") < 200, "a").otherwise("b").alias("lang")))
    index = engine.text_index("d", ["body"])
    again = Engine(spark, engine.catalog.root.rpartition("/")[0]).text_index("d", ["body"])
    assert again.path == index.path
    plan = index.of(["seven"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,seven)]" in plan or "In(term, [seven])" in plan
    found = [r.id for r in engine.sql("SELECT id FROM d WHERE body @@ 'seven' AND lang = 'b' LIMIT 3").collect()]
    assert found == [203, 210, 217]
    engine.sql("DELETE FROM d WHERE id = 203")
    assert engine.text_index("d", ["body"]).path != index.path
    assert [r.id for r in engine.sql("SELECT id FROM d WHERE body @@ 'seven' AND lang = 'b' LIMIT 2").collect()] == [210, 217]
    assert engine.catalog.vacuum("main", "d") >= 2 and engine.scan("d").count() == 100


def test_append_is_all_or_nothing(spark, engine):
    people(engine)
    failing = spark.range(5).select(F.col("id"), F.when(F.col("id") > 3, F.raise_error(F.lit("no")).cast("string")).otherwise("x").alias("nombre"), F.lit(1).cast("long").alias("edad"), F.lit(None).cast("date").alias("date"))
    before = engine.scan("Personas").count()
    with pytest.raises(Exception):  # noqa: B017
        engine.load("Personas", failing)
    assert engine.scan("Personas").count() == before == engine.catalog.rows("main", "Personas")
    assert engine.load("Personas", failing.limit(0)) == 0


def test_a_batch_tried_again_adds_nothing(spark, engine):
    engine.sql("CREATE TABLE t (id INT KEY)")
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert [engine.load("t", rows, stream=("s", 0)), engine.load("t", rows, stream=("s", 0)), engine.load("t", rows, stream=("s", 1)), engine.load("t", rows, stream=("other", 0))] == [2, 0, 2, 2]
    assert engine.scan("t").count() == 6


def test_buckets_prune_and_outlive_appends(spark, engine):
    people(engine)
    engine.catalog.hash_out("main", "Personas", "nombre", 4)
    hit = engine.search("Personas", "nombre", "Alice")
    assert names(hit) == ["Alice"] and len(hit.inputFiles()) == 1
    assert names(engine.sql("SELECT * FROM Personas WHERE nombre = 'Nobody'")) == []
    engine.sql("INSERT INTO Personas VALUES (7, 'Alice', 1, '2024-01-01')")
    assert names(engine.search("Personas", "nombre", "Alice")) == ["Alice", "Alice"]


def test_metrics(engine):
    people(engine)
    report = engine.collect("SELECT nombre FROM Personas WHERE edad > 26")
    assert report.count == 2 and report.rows_read >= 2 and report.files >= 1 and any("Scan" in n for n, _ in report.operators)
    m = engine.metrics
    assert m.counter("statements") == 1 and m.counter("rows loaded") == 3 and m.average_ms("statement") > 0 and m.average_ms("nothing") == 0
    assert "rows loaded,3" in m.to_csv() and '"statements": 1' in m.to_json()
    m.reset()
    assert m.report() == {"counters": {}, "timers": {}}


def wav(tone, seconds=0.5, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.sin(np.arange(int(rate * seconds)) * tone * 2 * np.pi / rate) * 20000).astype("<i2").tobytes())
    return out.getvalue()


def png_of(pixels):
    h, w = pixels.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows, last = b"", np.zeros(w, np.uint8)
    for y in range(h):  # the filters in turn
        kind = y % 3
        left = np.concatenate([[0], pixels[y, :-1]]).astype(np.uint8)
        rows += bytes([kind]) + (pixels[y] - (left if kind == 1 else last if kind == 2 else 0)).astype(np.uint8).tobytes()
        last = pixels[y]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_descriptors():
    a, b, c = (descriptors.mfcc(wav(t)) for t in (440, 440, 2500))
    assert a.shape[1] == 20 and len(a) == 22 and np.allclose(a, b) and np.abs(a[8:12] - c[8:12]).max() > 5
    assert descriptors.mfcc(b"no wav").shape == (0, 20) and descriptors.mfcc(wav(440, 0)).shape == (0, 20)
    image = np.random.default_rng(1).integers(0, 256, (40, 52)).astype(np.uint8)
    assert (descriptors.png(png_of(image))[:, :, 0] == image).all()
    d = descriptors.gradient_histograms(png_of(image))
    assert d.shape[1] == 128 and len(d) > 20 and np.allclose((d**2).sum(1), 1, atol=1e-5)
    assert np.allclose(d, descriptors.gradient_histograms(b"P5 52 40 255 " + image.tobytes()), atol=1e-6)
    assert len(descriptors.gradient_histograms(b"x")) == len(descriptors.gradient_histograms(png_of(np.zeros((30, 30), np.uint8)))) == 0


def test_media_index(spark, tmp_path):
    folder = tmp_path / "sounds"
    folder.mkdir()
    for i, tone in enumerate((300, 310, 900, 2000, 2100, 3000)):
        (folder / f"{i}.WAV").write_bytes(wav(tone, 1.0))
    (folder / "notes.txt").write_text("no sound")
    files = media.media_files(spark, f"file://{folder}", media.AUDIO)
    found = media.descriptors(files, descriptors.mfcc)
    index = similarity.MediaIndex(spark, f"file://{tmp_path}/media", "audio")
    assert index.status() == {"modality": "audio", "codebook": None, "index": None}
    with pytest.raises(FileNotFoundError):
        index.index(found)
    assert index.train(found, 16, per_object=30, most=100)["dim"] == 20 and index.index(found)["objects"] == 6
    again = similarity.MediaIndex(spark, f"file://{tmp_path}/media", "audio")
    assert again.status()["index"]["objects"] == 6 and again.status()["codebook"]["k"] == 16
    query = found.where(F.col("object_id").endswith("3.WAV"))
    for method in ("inverted", "sequential"):
        assert again.search(query, 3, method).first().object_id.endswith("3.WAV")
    with pytest.raises(ValueError):
        again.train(found, 8)


def test_sampled_descriptors_stop(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("object_id"), F.col("id").alias("desc_no"))
    some = similarity.sample_descriptors(rows, 10, most=95)
    per = {r.object_id: r["count"] for r in some.groupBy("object_id").count().collect()}
    assert set(per.values()) == {10} and 10 <= len(per) <= 12
    assert similarity.sample_descriptors(rows, 10).count() == 500


def test_stream(spark, tmp_path, engine):
    engine.sql("CREATE TABLE t (id INT KEY, name VARCHAR)")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long, name string").parquet(f"file://{tmp_path}/in")
    ingest(engine, "t", stream, f"file://{tmp_path}/cp").awaitTermination(60)
    assert engine.scan("t").count() == 2
    spark.createDataFrame([(3, "c")], "id long, name string").write.mode("append").parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        ingest(engine, "t", stream, f"file://{tmp_path}/cp").awaitTermination(60)
    assert engine.scan("t").count() == 3


def test_similarity(spark):
    import random

    rng = random.Random(7)
    rows = [(o, i, [rng.gauss(o, 1.0) for _ in range(4)]) for o in range(4) for i in range(25)]
    desc = spark.createDataFrame(rows, "object_id long, desc_no int, vec array<float>")
    book = similarity.train_codebook(similarity.sample_descriptors(desc, 20), 8)
    bow = similarity.soft_assign(desc, book).persist()
    norms = similarity.tfidf(bow, similarity.frequency(bow), 4).groupBy("object_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)
    query = bow.where("object_id = 2")
    a, b = similarity.sequential(bow, query, 4).collect(), similarity.inverted(bow, query, 4).collect()
    assert a[0].object_id == b[0].object_id == 2 and {r.object_id for r in b} <= {r.object_id for r in a}


def test_dialect():
    node = dialect.parse("""SELECT a, k FROM t WHERE txt @@ "l\\"amour" AND k = -1.5 LIMIT 3""")
    assert node == dialect.Select("t", ["a", "k"], [dialect.Predicate("txt", "MATCH", 'l"amour'), dialect.Predicate("k", "=", -1.5)], 3)
    assert dialect.parse("CREATE TABLE e USING INDEX btree(id), avl(name)").columns[0].primary
