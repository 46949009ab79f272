"""Growing files that come in numbered parts: the same entries as a read of the whole files, in any order and after restarts."""

import random

import pytest

from voxledger.plans.registry import default_registry
from voxledger.sources import logs
from voxledger.streaming import tail

COLUMNS = ["read_order", "line_start", "line_end", "start_byte", "end_byte", "text", "interpreted"]


def whole(name, n):
    """Lines of a file: orphans first, then headers with none to four continuations, one of them long, empty ones too."""
    rng = random.Random(name)
    lines = ["orphan é", ""] if name == "a" else []
    for i in range(n):
        lines.append(f"2025-01-15T13:00:{i % 60:02d}.5+00:00 host proc[1]: INFO - lo.gger - CallId={name}{i}")
        lines += ["x" * rng.choice([0, 3, 40, 5000]) for _ in range(rng.randrange(5))]
    return lines


def cut(lines, k, seed):
    """k parts that aren't empty, cut anywhere, inside blocks too."""
    at = sorted(random.Random(seed).sample(range(1, len(lines)), k - 1))
    return ["".join(x + "\n" for x in lines[i:j]) for i, j in zip([0, *at], [*at, len(lines)], strict=True)]


@pytest.fixture
def follow(spark, tmp_path):
    place = tmp_path / "parts"
    place.mkdir()

    def run(app, *names_and_parts):
        for name, text in names_and_parts:
            (place / name).write_text(text)
        tail.store_growing(spark, str(place), default_registry().get(app), str(tmp_path / "out"), str(tmp_path / "state"), 2).awaitTermination()

    return run


def batch_read(spark, tmp_path, app, files):
    folder = tmp_path / "whole"
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text("".join(x + "\n" for x in lines))
    return tail.entries_of(logs.physical_lines(spark, str(folder)), default_registry().get(app))


def rows(df):
    return sorted(map(str, df.select(COLUMNS).collect()))


def test_parts_in_any_order_and_repeated_batches_give_the_entries_of_whole_files(spark, tmp_path, follow):
    files = {"a": whole("a", 9), "b": whole("b", 4)}
    a, b = cut(files["a"], 5, 1), cut(files["b"], 3, 2)
    follow("ORK", ("a.log.2", a[2]), ("b.log.0", b[0]), ("notes.txt", "no part"))
    seen = tail.entries_so_far(spark, str(tmp_path / "out"))
    assert {r["text"] for r in seen.collect()} and seen.where("text like '%=a%'").isEmpty()  # a.log.2 waits
    follow("ORK", ("a.log.0", a[0]), ("b.log.2", b[2]), ("a.log.1", a[1]))
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver was lost before the batch was noted: it is repeated
    (tmp_path / "state" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    follow("ORK", ("a.log.4", a[4]), ("b.log.1", b[1]), ("a.log.3", a[3]))
    want = rows(batch_read(spark, tmp_path, "ORK", files))
    got = tail.entries_so_far(spark, str(tmp_path / "out"))
    assert rows(got) == want and len(want) == 15
    assert got.select("file_token", "entry_id").distinct().count() == 15
    kept = sorted(p.name for p in (tmp_path / "out" / "state").iterdir())
    assert len(kept) == 2  # the state of older batches goes
    lines = spark.read.parquet(str(tmp_path / "out" / "state" / kept[-1] / "lines"))
    assert lines.where("part is not null").isEmpty() and lines.select("file").distinct().count() == 2  # two open blocks, nothing waits


def test_lines_without_blocks(spark, tmp_path, follow):
    lines = [f"2025-01-15 13:00:00\tinfo\tl.og\tsaid {i}" for i in range(7)]
    parts = cut(lines, 3, 3)
    follow("VOCI", ("v.log.1", parts[1]), ("v.log.0", parts[0]))
    follow("VOCI", ("v.log.2", parts[2]))
    got = spark.read.parquet(str(tmp_path / "out" / "entries"))
    place = ["line_no", "start_byte", "end_byte", "text", "interpreted"]
    want = batch_read(spark, tmp_path, "VOCI", {"v": lines})
    assert sorted(map(str, got.select(place).collect())) == sorted(map(str, want.select(place).collect()))


def test_lines_of_parts_that_wait_are_written_once_and_go_when_their_turn_has_come(spark, tmp_path, follow):
    files = {"a": whole("a", 12), "b": whole("b", 5)}
    a, b = cut(files["a"], 8, 5), cut(files["b"], 3, 6)

    def held():
        return sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").glob("waiting/batch=*/of=*") if any(p.glob("*.parquet")))

    def kept():
        last = max((tmp_path / "out" / "state").iterdir(), key=lambda p: int(p.name.split("=")[1]))
        return spark.read.parquet(str(last / "lines"))

    follow("ORK", ("a.log.1", a[1]), ("a.log.2", a[2]))
    first = held()
    assert len(first) == 1 and kept().isEmpty()
    follow("ORK", ("a.log.4", a[4]), ("b.log.1", b[1]))
    follow("ORK", ("a.log.6", a[6]))
    assert len(held()) == 4 and kept().isEmpty()  # those of one batch aren't written again by the next
    follow("ORK", ("a.log.0", a[0]))  # 0 to 2 are there, 4 and 6 wait still
    follow("ORK", ("a.log.3", a[3]), ("a.log.1.bak", "no part"))
    assert first[0] not in held() and len(held()) == 3
    follow("ORK", ("b.log.0", b[0]), ("a.log.5", a[5]))
    follow("ORK", ("b.log.2", b[2]), ("a.log.7", a[7]))
    assert held() == []
    got = tail.entries_so_far(spark, str(tmp_path / "out"))
    want = rows(batch_read(spark, tmp_path, "ORK", files))
    assert rows(got) == want and got.select("file_token", "entry_id").distinct().count() == len(want) == 19
    assert kept().select("file").distinct().count() == 2
