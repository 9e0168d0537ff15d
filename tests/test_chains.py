"""Chains of intervals against a walk along the time axis."""

import datetime as dt
import random

from ticketlake.operators import invites, rate
from ticketlake.plans.chains import chain


def test_chain_equals_walk(spark):
    rng = random.Random(5)
    points = []
    for key in range(12):
        at = sorted(rng.sample(range(400), rng.randrange(1, 60)))
        points += [(key, a, a + rng.choice([1, 5, 20, 90])) for a in at]
    points += [(99, a, a + 7) for a in range(300)]  # a key that never pauses
    want, busy = set(), {}
    for key, at, until in sorted(points):
        if busy.get(key, -1) <= at:
            want.add((key, at))
            busy[key] = until
    got = chain(spark.createDataFrame(points, "key long, at long, until long")).collect()
    assert {(r.key, r.at) for r in got} == want and len(got) == len(want)
    assert chain(spark.createDataFrame([], "key long, at long, until long")).count() == 0


def test_anchored_windows(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, t(7), 1), (1, t(14), 2), (1, t(21), 1), (1, t(22), 1), (1, t(37), 1), (2, t(3), 21), (None, t(1), 5)]
    got = rate.anchored_windows(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, requests long")).collect()
    assert {(r.user_id, r.window_start, r.requests, r.over_auth, r.over_all) for r in got} == {
        (1, t(7), 4, False, False), (1, t(22), 1, False, False), (1, t(37), 1, False, False), (2, t(3), 21, True, False)}


def test_invitations_equal_one_by_one(spark):
    rng = random.Random(2)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * n)
    users = [(1, "A@x.org "), (2, "b@x.org")]
    old = [(i, rng.choice(["c@x.org", "d@x.org", "e@x.org"]), day(c := rng.randrange(120)),
            rng.choice([None, day(c + 5)]), day(c + 28)) for i in range(6)]
    asked = [(s, rng.choice(["a@x.org", " C@x.org", "c@x.org", "d@x.org", "E@X.org", "nobody", None]),
              rng.choice(["agent", "admin", "agent", "guest", None] if s % 4 == 0 else ["agent"]), 1, day(rng.randrange(160)))
             for s in range(120)]
    cancels = [(invites.NEW_IDS + s, asked[s][4] + dt.timedelta(hours=rng.randrange(-5, 60))) for s in range(0, 120, 9)]
    cancels += [(i, day(rng.randrange(120))) for i in range(0, 6, 2)]
    gone = dict(cancels)
    want, mine = {}, []
    for s, email, role, _, at in sorted(asked, key=lambda r: (r[4], r[0])):
        e = (email or "").strip().lower()
        if "@" not in e:
            want[s] = "bad_email"
        elif role not in ("agent", "admin", "supervisor"):
            want[s] = "bad_role"
        elif e in ("a@x.org", "b@x.org"):
            want[s] = "user_exists"
        elif any(m == e and c <= at and x > at and (u is None or u > at) and (i not in gone or gone[i] > at or gone[i] <= c)
                 for i, m, c, u, x in old + mine):
            want[s] = "pending_exists"
        else:
            want[s] = None
            mine.append((invites.NEW_IDS + s, e, at, None, at + dt.timedelta(days=7)))
    d = invites.invite_users(
        spark.createDataFrame(users, "id long, email string"),
        spark.createDataFrame(old, "id long, email string, created_at timestamp_ntz, used_at timestamp_ntz, expires_at timestamp_ntz"),
        spark.createDataFrame(asked, "seq long, email string, role string, actor_id long, asked_at timestamp_ntz"),
        spark.createDataFrame(cancels, "invitation_id long, cancel_at timestamp_ntz"))
    assert {r.seq: r.reason for r in d.collect()} == want
    assert {"pending_exists", None} <= set(want.values())
