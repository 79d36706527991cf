"""Items materialised from attempts in any cut into batches, against a plain fold."""

import random
from datetime import datetime, timedelta, timezone

from provenir.streaming import materialise as M

WAIT = timedelta(hours=1)
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows):
    end, out = max(r[2] for r in rows), {}
    for item in {r[0] for r in rows if r[0] is not None}:
        tried, last = 0, None
        for _, _, ts, kind in sorted((r for r in rows if r[0] == item), key=lambda r: (r[2], r[1])):
            if tried and ts > last + WAIT:
                out[item] = (tried, "expired")
                break
            tried, last = tried + 1, ts
            if kind not in M.RETRYABLE or tried == M.MOST:
                out[item] = (tried, f"gave up: {kind}" if kind in M.RETRYABLE else kind)
                break
        else:
            if last + WAIT <= end:
                out[item] = (tried, "expired")
    return out


def test_any_cut_into_batches_gives_the_fold(spark):
    rnd = random.Random(3)
    rows = sorted(((rnd.choice([*range(40), None]), i, START + timedelta(seconds=rnd.randrange(60_000)), rnd.choice(["empty", "parse-error", "empty", "forbidden", "read"])) for i in range(260)), key=lambda r: r[2])
    rows += [(90, 1000, rows[-1][2], "empty"), (91, 1001, rows[-1][2], "read")]
    form = "item long, attempt_id long, ts timestamp, kind string"
    want = plain(rows)
    for cuts in ([len(rows)], [80, 150, len(rows)]):
        parts = [spark.createDataFrame(rows[a:b], form) for a, b in zip([0, *cuts], cuts)]
        got = M.in_batches(spark, parts, WAIT).collect()
        assert len(got) == len({r.item for r in got})  # an item is closed once
        assert {r.item: (r.attempts, r.outcome) for r in got} == want
    assert {"expired", "read", "forbidden"} < {o for _, o in want.values()} and any(o.startswith("gave up") for _, o in want.values())
