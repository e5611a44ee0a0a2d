import json

from quillon.streaming import sessions


def test_tools_are_counted_by_day(spark, tmp_path):
    def line(day, *tools):
        return json.dumps({"type": "assistant", "timestamp": f"2024-05-0{day}T10:00:00Z", "message": {"content": [{"type": "tool_use", "name": t, "input": {}} for t in tools]}})

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join([line(1, "Read", "Read"), line(2, "Bash"), "{broken", '{"type":"assistant"}']))
    (tmp_path / "in/b.jsonl").write_text(line(1, "Read") + "\n")
    counted = sessions.tool_counts(sessions.read_stream(spark, f"file://{tmp_path}/in"))
    assert counted.isStreaming
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("counted").collect()))
    assert got == [("2024-05-01", "a", "Read", 2), ("2024-05-01", "b", "Read", 1), ("2024-05-02", "a", "Bash", 1)]
