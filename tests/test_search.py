"""The sliced search against a server that answers no offset beyond its window."""

import json
import random
import threading
import time
import urllib.error
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from florascope.sources import readers

WINDOW = 400


@pytest.fixture(scope="module")
def service():
    """3000 records: a dense city, a line on the sides of slices, and scattered ones; every tenth call is throttled once."""
    rng = random.Random(4)
    at = [(rng.gauss(10, 0.01), rng.gauss(50, 0.01)) for _ in range(2000)] + [(0.0, rng.uniform(-90, 90)) for _ in range(300)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(700)]
    state = {"calls": 0, "throttled": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: float(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            state["calls"] += 1
            if state["calls"] % 10 == 0:
                state["throttled"] += 1
                self.send_response(429)
                self.send_header("Retry-After", "0.01")
                self.end_headers()
                return
            inside = [k for k, (x, y) in enumerate(at) if q["west"] <= x <= q["east"] and q["south"] <= y <= q["north"]]
            if "offset" not in q:
                body = {"count": len(inside)}
            elif q["offset"] + q["limit"] > WINDOW:
                self.send_response(400)
                self.end_headers()
                return
            else:
                body = {"results": [{"key": k, "x": at[k][0]} for k in inside[int(q["offset"]) : int(q["offset"] + q["limit"])]]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    box = "west={west}&south={south}&east={east}&north={north}"
    yield f"http://127.0.0.1:{server.server_port}/s?{box}&offset={{offset}}&limit={{limit}}", f"http://127.0.0.1:{server.server_port}/n?{box}", at, state
    server.shutdown()


def test_all_rows_beyond_the_window_come_once(spark, service):
    url, count_url, at, state = service
    got = sorted(int(r["id"]) for r in readers.sliced_search(spark, url, count_url, window=WINDOW, page=100).collect())
    assert got == list(range(len(at))) and state["throttled"] > 3


def test_quotas_follow_the_results(spark, service):
    url, count_url, at, _ = service
    got = [int(r["id"]) for r in readers.sliced_search(spark, url, count_url, max_records=600, window=WINDOW, page=100).collect()]
    assert 500 <= len(got) <= 650 and len(set(got)) == len(got)
    assert 0.5 < sum(k < 2000 for k in got) / len(got) < 0.8
    assert readers.quotas([10, 0, 90], 50) == [5, 0, 45] and readers.quotas([3, 4], 10) == [3, 4] and readers.quotas([1, 999], 100) == [1, 100]


def test_what_cannot_be_read_is_an_error(spark, service):
    _, count_url, _, _ = service
    with pytest.raises(ValueError, match="more than"):
        readers.slices(lambda box: 500 if box[0] <= 1 <= box[2] and box[1] <= 1 <= box[3] else 0, WINDOW, 0.01)
    with pytest.raises(ValueError, match="count_url"):
        readers.PagedReader({"url": "x", "total": "9901"}).partitions()
    assert len(readers.PagedReader({"url": "x", "total": "9900"}).partitions()) == 33


def test_calls_end_at_client_errors_and_after_their_attempts(service):
    url = service[0]
    with pytest.raises(urllib.error.HTTPError):
        for _ in range(2):  # the first may be throttled, which is tried again
            readers.fetch(url.format(west=0, south=0, east=1, north=1, offset=WINDOW, limit=1), 2)
    start = time.perf_counter()
    with pytest.raises(urllib.error.URLError):
        readers.fetch("http://127.0.0.1:9/none", 2, patience=0.05)
    assert time.perf_counter() - start < 5


def test_no_results(spark, service):
    url = service[0]
    assert readers.slices(lambda box: 0, 10, 1.0) == []
    spark.dataSource.register(readers.PagedSource)
    assert spark.read.format("paged").option("url", url).option("total", 0).load().count() == 0
