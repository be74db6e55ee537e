"""The stream of a repository's changes: offsets that can be read again, bursts settled by timers, a restart from the checkpoint."""

import json
import time

from strataloom.streaming import feed


def test_reader_gives_the_same_events_again(tmp_path):
    root, log = tmp_path / "r", tmp_path / "log"
    (root / "src").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "src/a.ts").write_text("1")
    reader = feed.ChangeReader(str(root), str(log), set(feed.SKIPPED))
    begin = reader.initialOffset()
    assert begin == {"number": 0} and list(reader.read(begin)[0]) == []
    (root / "src/a.ts").write_text("22")
    (root / "b.ts").write_text("1")
    (root / ".git/x").write_text("1")
    rows, end = reader.read(begin)
    assert [r[:2] for r in rows] == [("b.ts", "added"), ("src/a.ts", "modified")] and end == {"number": 1}
    again = feed.ChangeReader(str(root), str(log), set(feed.SKIPPED))  # a driver that has been started anew
    assert [r[:2] for r in again.readBetweenOffsets(begin, end)] == [("b.ts", "added"), ("src/a.ts", "modified")]
    (root / "b.ts").unlink()
    rows, last = again.read(end)
    assert [r[:2] for r in rows] == [("b.ts", "deleted")] and last == {"number": 2}
    again.commit(last)
    assert list(again.readBetweenOffsets(last, last)) == [] and not (log / "1.json").exists()


def test_restart_sees_every_change_once(spark, tmp_path):
    """The stream is stopped while a burst waits for its timer and while files change; started again, each burst comes out once."""
    root = tmp_path / "r"
    root.mkdir()
    (root / "old.ts").write_text("1")
    seen, out = [], str(tmp_path / "state")
    apply = lambda batch, n: seen.extend(tuple(r) for r in batch.select("filename", "edit").collect())

    def until(names, seconds=40):
        end = time.time() + seconds
        while {n for n, _ in seen} < names and time.time() < end:
            time.sleep(0.3)

    first = feed.start(spark, str(root), out, apply, gap_ms=500, every="500 milliseconds")
    while not (tmp_path / "state/looks/seen.json").exists():
        time.sleep(0.2)
    for k in range(3):
        (root / "a.ts").write_text("x" * (k + 2))
        time.sleep(0.05)
    until({"a.ts"})
    (root / "b.ts").write_text("y")
    first.stop()
    (root / "c.ts").write_text("z")
    (root / "old.ts").unlink()
    second = feed.start(spark, str(root), out, apply, gap_ms=500, every="500 milliseconds")
    until({"a.ts", "b.ts", "c.ts", "old.ts"})
    time.sleep(2)
    second.stop()
    assert sorted(seen) == [("a.ts", "added"), ("b.ts", "added"), ("c.ts", "added"), ("old.ts", "deleted")] or sorted(set(seen)) == [("a.ts", "added"), ("a.ts", "modified"), ("b.ts", "added"), ("c.ts", "added"), ("old.ts", "deleted")]
    assert json.loads((tmp_path / "state/looks/seen.json").read_text())["number"] >= 2
