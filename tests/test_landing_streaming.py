import os

from casemill.sources import landing, tables
from casemill.streaming import jobs


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def files(root):
    put(root, "litigios/a.csv", "﻿ID;Estado;Nota\n1;Activo;\n2;Cerrado\n\n3;x;y;z\n".encode())
    put(root, "litigios/b.csv", b"a,b;c\n1,2;3\n")
    put(root, "cumplimiento/c.csv", b"ID\nuno\ndos\n")
    put(root, "cumplimiento/d.csv", b"a\x00b")
    put(root, "cumplimiento/e.csv", b"\xff\xfea,b\n")
    put(root, "contratos_documentos/f.pdf", b"%PDF-1.7 x")
    put(root, "contratos_documentos/g.pdf", b"a,b\n1,2\n")
    put(root, "contratos_documentos/h.exe", b"a,b\n1,2\n")
    put(root, "otra/i.csv", b"a,b\n1,2\n")
    put(root, "auditoria_interna/j.csv", b"a|b\n1|2\n1|2|3\n")


def test_landing(spark, tmp_path):
    files(str(tmp_path))
    found = landing.classify_files(landing.read_landing(spark, str(tmp_path)))
    got = {r.locator: (r.family, r.detected_format, r.cause) for r in found.collect()}
    assert got == {
        "litigios/a.csv": ("LITIGIOS", "CSV", None), "litigios/b.csv": ("LITIGIOS", "CSV", None), "cumplimiento/c.csv": ("CUMPLIMIENTO", "CSV", None),
        "cumplimiento/d.csv": ("CUMPLIMIENTO", "CSV", "BINARY_CONTENT"), "cumplimiento/e.csv": ("CUMPLIMIENTO", "CSV", "UNSUPPORTED_ENCODING"),
        "contratos_documentos/f.pdf": ("CONTRATOS_DOCUMENTOS", "PDF", None), "contratos_documentos/g.pdf": ("CONTRATOS_DOCUMENTOS", "CSV", "FORMAT_MISMATCH"),
        "contratos_documentos/h.exe": ("CONTRATOS_DOCUMENTOS", "CSV", "UNSUPPORTED_EXTENSION"), "auditoria_interna/j.csv": ("AUDITORIA_INTERNA", "CSV", None),
    }
    good = found.where("accepted and detected_format = 'CSV'")
    marks = {r.locator: (r.delimiter, r.cause) for r in landing.infer_delimiter(good).join(good.select("file_id", "locator"), "file_id").collect()}
    assert marks["litigios/b.csv"] == (None, "AMBIGUOUS_DELIMITER") and marks["cumplimiento/c.csv"] == (",", None)
    assert marks["litigios/a.csv"][1] == "UNDETERMINABLE_STRUCTURE" and marks["auditoria_interna/j.csv"][1] == "UNDETERMINABLE_STRUCTURE"
    one = good.where("locator = 'litigios/a.csv'").selectExpr("file_id", "content", "';' as delimiter")
    rows = landing.read_delimited(one)
    assert [(r.row_number, r.cells) for r in rows.orderBy("row_number").collect()] == [(1, ["ID", "Estado", "Nota"]), (2, ["1", "Activo", ""]), (3, ["2", "Cerrado"]), (5, ["3", "x", "y", "z"])]
    payload = {r.row_number: r.payload for r in landing.to_payload(rows).collect()}
    assert payload == {2: {"ID": "1", "Estado": "Activo", "Nota": ""}, 3: {"ID": "2", "Estado": "Cerrado"}, 5: {"ID": "3", "Estado": "x", "Nota": "y", "column_4": "z"}}
    assert landing.enforce_tabular_limits(rows).count() == 0
    assert landing.reject_oversize(found, 20).count() == 1


def test_receipts(spark):
    old = spark.createDataFrame([("a", "h1", "ana", "k1", 1), ("b", "h2", "ana", None, 4)], "locator string, content_sha256 string, actor string, idempotency_key string, revision int")
    new = spark.createDataFrame([("a", "h1", "ana", None, 1), ("a", "h3", "ana", "k1", 2), ("b", "h4", "eva", "k1", 3), ("b", "h4", "eva", None, 4), ("c", "h5", "eva", "k9", 5), ("c", "h6", "eva", "k9", 6)], "locator string, content_sha256 string, actor string, idempotency_key string, turn int")
    got = {r.turn: r.outcome for r in landing.dedupe_receipts(new, old).collect()}
    assert got == {1: "REPLAYED", 2: "CONFLICT", 3: "NEW", 4: "REPLAYED", 5: "NEW", 6: "CONFLICT"}
    assert {r.turn: r.revision for r in landing.next_revision(new.where("turn in (2, 3, 4, 5)"), old).collect()} == {2: 2, 3: 5, 4: 6, 5: 1}


def test_write_modes(spark, tmp_path):
    at = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(rows, "k int, v string, o int")
    tables.write_table(spark, df((1, "a", 1), (1, "b", 2), (2, "c", 1)), at, ["k"], "update", "o")
    tables.write_table(spark, df((1, "x", 9), (3, "d", 1), (3, "e", 2)), at, ["k"], "ignore", "o")
    assert sorted(map(tuple, spark.read.parquet(at).select("k", "v").collect())) == [(1, "b"), (2, "c"), (3, "d")]
    out = tables.write_table(spark, df((2, "z", 5)), at, ["k"], "update", "o")
    assert sorted(map(tuple, out.select("k", "v").collect())) == [(1, "b"), (2, "z"), (3, "d")]


def test_ingest_is_incremental(spark, tmp_path):
    root, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(root, "litigios/a.csv", b"a,b\n1,2\n")
    jobs.ingest_landing(spark, root, out, mark).awaitTermination(120)
    put(root, "litigios/b.csv", b"a,b\n3,4\n")
    put(root, "cumplimiento/c.csv", b"x")
    jobs.ingest_landing(spark, root, out, mark).awaitTermination(120)
    assert sorted(r.locator for r in spark.read.parquet(out).collect()) == ["cumplimiento/c.csv", "litigios/a.csv", "litigios/b.csv"]


def test_streams(spark, tmp_path):
    src, a, b = (str(tmp_path / x) for x in ("src", "a", "b"))
    rows = [(1, 1, "REINJECT", False, None, "2024-01-05"), (1, 2, "REINJECT", True, None, "2024-02-05"), (1, 3, "DISCARD", None, "x", "2024-01-31"), (2, 1, "DISCARD", None, " ", "2024-03-01"), (3, 1, "DISCARD", None, "dup", "2023-12-31")]
    layout = "item_id long, turn int, action string, conforming boolean, reason string, day string"
    spark.createDataFrame(rows, layout).write.parquet(src)
    stream = spark.readStream.schema(layout).parquet(src)
    jobs.quarantine_items(stream).writeStream.outputMode("update").format("memory").queryName("items").option("checkpointLocation", a).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("items").collect())) == [(1, "Reinyectado", 2), (2, "Pendiente", 0), (3, "Descartado", 1)]
    counts = jobs.monthly_counts(stream.selectExpr("to_date(day) as day"), "day")
    counts.writeStream.outputMode("complete").format("memory").queryName("months").option("checkpointLocation", b).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((str(r.month), r.n) for r in spark.table("months").collect()) == [("2023-12-01", 1), ("2024-01-01", 2), ("2024-02-01", 1), ("2024-03-01", 1)]
    for _ in range(2):
        jobs.event_log(stream.select("item_id", "action", "day"), str(tmp_path / "log"), str(tmp_path / f"c{_}"), ["item_id", "action"], "day").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
