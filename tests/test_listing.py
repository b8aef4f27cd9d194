"""The listing as a stream: across the wall of pages, through restarts, each id once."""

import json

import pytest

from rostrum.streaming import listing


def rows(n, each=7, start=0):
    return [{"id": f"c{i:04}", "modified": f"2024-01-{1 + i // each // 24:02}T{i // each % 24:02}"} for i in range(start, start + n)]


def start(spark, tmp_path, name):
    source = spark.readStream.format("listing").option("path", f"{tmp_path}/in").option("size", 5).option("pages", 4).load()
    return source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").queryName(name).start()


def test_a_stopped_listing_goes_on(spark, tmp_path):
    spark.dataSource.register(listing.ListingSource)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(rows(90)))
    got = lambda: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    query = start(spark, tmp_path, "first")
    query.processAllAvailable()
    query.stop()
    assert got() == [r["id"] for r in rows(90)]
    # new rows, some of them at the time of the last ones
    (tmp_path / "in" / "b.json").write_text(json.dumps(rows(60, start=90)))
    query = start(spark, tmp_path, "second")
    query.processAllAvailable()
    query.stop()
    assert got() == [r["id"] for r in rows(150)]


def test_a_batch_can_be_read_again():
    have = rows(40)
    page = lambda since, number: [r for r in have if since is None or r["modified"] >= since][(number - 1) * 5 : number * 5]
    reader = listing._ListingReader(page, 5, 2)
    at, all_ids = reader.initialOffset(), []
    while True:
        found, end = reader.read(at)
        found = list(found)
        if not found:
            break
        have += [{"id": f"late{len(all_ids)}", "modified": end["since"]}] if len(all_ids) < 30 else []
        have.sort(key=lambda r: (r["modified"], r["id"]))
        assert list(reader.readBetweenOffsets(at, end)) == found and len(end["seen"]) <= 20
        all_ids += [i for i, _ in found]
        at = end
    assert len(set(all_ids)) == len(all_ids) and set(all_ids) == {r["id"] for r in have}


@pytest.mark.parametrize(("size", "pages", "each"), [(5, 2, 3), (4, 3, 1), (250, 20, 7)])
def test_cursor_moves_past_the_wall(size, pages, each):
    have = rows(120, each)
    page = lambda since, number: [r for r in have if since is None or r["modified"] >= since][(number - 1) * size : number * size]
    assert list(listing.cursor(page, size, pages)) == [r["id"] for r in have]
    assert list(listing.cursor(lambda since, number: [], size, pages)) == []
    # more rows at one time than the listing shows: it ends there
    same = [{"id": f"s{i}", "modified": "t"} for i in range(40)]
    shown = list(listing.cursor(lambda since, number: same[(number - 1) * 5 : number * 5], 5, 2))
    assert shown == [r["id"] for r in same[:10]]
