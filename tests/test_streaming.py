from plumbline.sources import sinks
from plumbline.streaming import corrections


def test_corrections_stream(spark, tmp_path):
    a, b = ("a", None, 1.0, "m", None, None), ("a", None, 2.0, "m", None, None)
    sinks.append_correction(spark, f"{tmp_path}/log", [("2024-01-01 00:10:00", "p", "ui", "", a, b), ("2024-01-01 00:20:00", "p", "ui", "", a, a), ("2024-01-01 02:00:00", "p", "ui", "", a, b), ("bad", "p", "ui", "", a, b)])
    q = corrections.fixes_by_window(corrections.read_stream(spark, f"{tmp_path}/log")).writeStream.outputMode("complete").format("memory").queryName("fixes").start()
    try:
        q.processAllAvailable()
        got = {str(r["window"]["start"]): (r["total"], r["quantity_fixes"]) for r in spark.sql("select * from fixes").collect()}
    finally:
        q.stop()
    assert got == {"2024-01-01 00:00:00": (2, 1), "2024-01-01 02:00:00": (1, 1)}
