from collatio.streaming import upsert


def test_last_write_wins_over_batches(spark, tmp_path):
    schema = "unit string, witness string, status string, ord long"
    for i, rows in enumerate(([("u", "w", "PRESENT", 1), ("v", "w", "ABSENT", 2)], [("u", "w", "ABSENT", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upsert.follow(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {r.unit: r.status for r in upsert.latest(spark, f"{tmp_path}/out").collect()}
    assert got == {"u": "ABSENT", "v": "ABSENT"} and upsert.latest(spark, f"{tmp_path}/none") is None
