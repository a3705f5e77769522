"""Archives, stores, JSON with comments, streaming limits and resumable runs."""

import gzip
import io
import json
import tarfile

from pyspark.sql import functions as F

from quarrykit.config import IndexConfig
from quarrykit.sources import archive as A
from quarrykit.sources import jsonc, store
from quarrykit.streaming import limits, resume


def tar(entries):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, body in entries:
            i = tarfile.TarInfo(name)
            if body is None:
                i.type, i.linkname = tarfile.SYMTYPE, "x"
                t.addfile(i)
            else:
                i.size = len(body)
                t.addfile(i, io.BytesIO(body))
    return gzip.compress(raw.getvalue())


def test_archive_outcomes(spark, tmp_path):
    good = tar([("r-1/src/a.ts", b"const a = 1;\n"), ("r-1/../evil.ts", b"x"), ("/abs.ts", b"x"), ("r-1/node_modules/x.js", b"x"), ("r-1/link", None), ("r-1/big.ts", b"a\n" * 600), ("r-1/g.ts", b"// @generated\n"),
                ("r-1/b.ts", b"\0\1"), ("r-1/m.js", b"x" * 5000), ("alone.ts", b"x")])
    (tmp_path / "a.tar.gz").write_bytes(good)
    (tmp_path / "cut.tar.gz").write_bytes(good[: len(good) // 2])
    rows = A.scan(spark, str(tmp_path), A.Limits(file=1000)).collect()
    by = {(r.archive.rsplit("/", 1)[-1], r.raw_path): (r.outcome, r.reason) for r in rows}
    g = lambda p: by[("a.tar.gz", p)]
    assert g("r-1/src/a.ts") == ("delivered", None) and g("r-1/../evil.ts") == ("rejected", "traversal") and g("/abs.ts") == ("rejected", "absolute")
    assert g("r-1/node_modules/x.js") == ("skipped", "vendored") and g("r-1/link")[0] == "not-a-file" and g("r-1/big.ts") == ("skipped", "too-large")
    assert g("r-1/g.ts") == ("skipped", "generated") and g("r-1/b.ts") == ("skipped", "binary-content") and g("alone.ts") == ("rejected", "no-root")
    assert any(k[0] == "cut.tar.gz" and v[0] == "damaged" for k, v in by.items())


def test_archive_bomb():
    bomb = tar([("r/z.ts", b"0" * 3_000_000)])
    rows = list(A.read_archive("x", bomb, A.Limits(uncompressed=1_000_000)))
    assert rows[-1][4:6] == ("limit", "uncompressed-bytes")
    many = tar([(f"r/{i}.ts", b"x") for i in range(5)])
    assert [r[4] for r in A.read_archive("x", many, A.Limits(entries=3))] == ["delivered"] * 3 + ["limit"]


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("o/r", "s1", 1, "x"), ("o/r", "s2", 2, "y")], "repo STRING, sha STRING, chunk_id BIGINT, term STRING")
    store.write(df, str(tmp_path), "postings", IndexConfig())
    assert sorted(r.chunk_id for r in store.read(spark, str(tmp_path), "postings", IndexConfig()).collect()) == [1, 2]
    assert store.config_key(IndexConfig()) != store.config_key(IndexConfig(verb_stemming=True))


def test_lock(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_text("1")
    (tmp_path / "b.json").write_text("2")
    lock = spark.createDataFrame([("a.json", hashlib.sha256(b"1").hexdigest()), ("b.json", "0"), ("c.json", "0")], "name STRING, sha256 STRING")
    assert sorted(r.name for r in store.locked(spark, str(tmp_path), lock).collect()) == ["b.json", "c.json"]


def test_jsonc(spark):
    texts = ['{"a": 1, // c\n "b": [1, 2,], /* x */ }', '{"u": "http://x//y", "v": "/* no */"}', "{", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(jsonc.plain_json(F.col("t"))).collect()]
    assert json.loads(got[0]) == {"a": 1, "b": [1, 2]} and json.loads(got[1])["u"] == "http://x//y" and got[2] is None and got[3] is None
    assert jsonc.leaves({"a": "x", "b": {"c": ["y", 1, {"d": "z"}]}}) == ["x", "y", "z"]


def test_stream_equals_batch(spark, tmp_path):
    from quarrykit.operators import state as S

    ev = spark.createDataFrame([(i, i % 3, 1_700_000_000_000 + i * 200) for i in range(60)], "event_id BIGINT, user_id BIGINT, t BIGINT").withColumn("ts", F.timestamp_millis("t"))
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = limits.token_bucket(src, "user_id", "ts", 2, 4000).writeStream.format("memory").queryName("bucket_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    stream = {r.event_id: r.admitted for r in spark.table("bucket_out").collect()}
    batch = {r.event_id: r.admitted for r in S.token_bucket(ev, "user_id", 2, 4000).collect()}
    assert stream == batch and len(stream) == 60


def test_resume(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"id":"a","status":"answered","n":1}\n{"id":"a","status":"rejected","n":2}\n{"id":"b","status":"provider_error","n":3}\n{"id":"c","sta')
    done = resume.last_records(spark, str(p), "id STRING, status STRING, n INT", "id", "n")
    assert [(r.id, r.n) for r in done.collect()] == [("a", 2)]
    specs = spark.createDataFrame([("a",), ("b",), ("c",)], "id STRING")
    assert sorted(r.id for r in resume.remaining(specs, done, "id").collect()) == ["b", "c"]
