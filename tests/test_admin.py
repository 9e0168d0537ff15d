"""Change jobs against simulations that take one request after the other."""

import random

import pytest

from ticketlake.operators import admin, category_edits

CATS = "id long, name string, parent_id long"


def _one_by_one(cats, used, requests):
    tree, reasons, log = {i: [n, p] for i, n, p in cats}, {}, [i for i, _, _ in cats]
    for seq, op, target, name, parent in sorted(requests):
        up, chain = parent, []
        while up is not None and up in tree and up not in chain:
            chain.append(up)
            up = tree[up][1]
        round_ = up in chain or up == target
        if (op == "insert" or (op == "patch" and name is not None)) and not (name or "").strip():
            reason = "blank_name"
        elif op == "patch" and parent == target:
            reason = "loop"
        elif op == "delete" and target in used:
            reason = "in_use"
        elif op == "insert" and target in log:
            reason = "id_exists"
        elif op != "insert" and target not in tree:
            reason = "not_found"
        elif op != "delete" and parent is not None and parent not in tree:
            reason = "parent_not_found"
        elif op == "patch" and (target in chain or round_):
            reason = "loop"
        else:
            reason = None
            if op == "insert":
                tree[target] = [name, parent]
                log.append(target)
            elif op == "patch":
                tree[target] = [tree[target][0] if name is None else name, parent]
            else:
                del tree[target]
                for x in tree.values():
                    x[1] = None if x[1] == target else x[1]
        reasons[seq] = reason
    return reasons, {i: tuple(x) for i, x in tree.items()}


def _category_job(spark, cats, used, requests):
    df = spark.createDataFrame([(*r, 7, None) for r in requests], category_edits.REQUEST.replace("parent_id bigint", "p bigint")) \
        .withColumnRenamed("p", "parent_id").select("seq", "op", "target_id", "name", "parent_id", "actor_id", "changed_at")
    base = spark.createDataFrame(cats, CATS)
    d = category_edits.decided(base, spark.createDataFrame([(u, 1) for u in used], "category_id long, counter int"), df)
    return ({r.seq: r.reason for r in d.collect()},
            {r.id: (r.name, r.parent_id) for r in category_edits.after(base, d).collect()},
            {r.seq: r.target_name for r in category_edits.change_log(d, base).collect()})


@pytest.mark.parametrize("few", [category_edits.FEW, 0])
def test_category_requests_equal_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(category_edits, "FEW", few)
    for seed in range(3 if few else 1):
        rng = random.Random(seed)
        n = 8
        cats = [(i, f"c{i}", None if i < 3 else rng.randrange(i)) for i in range(n)]
        requests = [(s, rng.choice(["patch"] * 12 + ["insert", "insert", "delete"]), rng.randrange(n + 3),
                     rng.choice([None, "n", f"name{s}", f"name{s}", " "] if s % 5 == 0 else [f"name{s}"]),
                     rng.choice([None, *range(n + 4)])) for s in range(45 if few else 12)]
        reasons, tree, log = _category_job(spark, cats, [2], requests)
        assert (reasons, tree) == _one_by_one(cats, [2], requests), seed
        assert "loop" in reasons.values() and len(log) > 0


def test_category_patch_is_refused_by_the_tree_of_its_time(spark):
    """2 may not go under 1 while 1 is under 2, although 1 becomes a root later."""
    got, tree, _ = _category_job(spark, [(1, "a", None), (2, "b", None)], [], [
        (1, "patch", 1, None, 2), (2, "patch", 2, None, 1), (3, "patch", 1, None, None)])
    assert got == {1: None, 2: "loop", 3: None} and tree[2] == ("b", None)


@pytest.mark.parametrize("few", [category_edits.FEW, 0])
def test_category_walks_jump_over_untouched_chains(spark, monkeypatch, few):
    """A chain of 600 untouched categories, a loop of untouched ones, a touched chain of 12."""
    monkeypatch.setattr(category_edits, "FEW", few)
    cats = [(i, "c", i - 1 if i else None) for i in range(600)] + [(900, "l", 901), (901, "l", 900)]
    cats += [(1000 + i, "t", 1000 + i - 1 if i else None) for i in range(12)]
    requests = [(i + 1, "patch", 1000 + i, f"t{i}", 1000 + i - 1 if i else None) for i in range(12)]
    requests += [(20, "patch", 0, None, 599), (21, "patch", 300, None, 599), (22, "patch", 599, None, None),
                 (23, "patch", 0, None, 599), (24, "patch", 1000, None, 1011), (25, "patch", 900, None, 901),
                 (26, "patch", 1000, None, 900)]
    got, tree, _ = _category_job(spark, cats, [], requests)
    assert (got, tree) == _one_by_one(cats, [], requests)
    assert got[20] == got[21] == got[24] == "loop" and got[23] is None


def test_category_requests_of_nothing(spark):
    assert _category_job(spark, [(1, "a", None)], [], [])[:2] == ({}, {1: ("a", None)})
    assert _category_job(spark, [], [], [(1, "insert", 5, "n", None), (2, "patch", 5, None, 5)])[0] == {1: None, 2: "loop"}


def test_cycle_check_at_depth(spark):
    """A chain of 1,200 categories, a loop, and a dangling parent."""
    from ticketlake.operators import tree
    cats = [(i, "c", i - 1 if i else None) for i in range(1200)]
    cats += [(5000, "l", 5001), (5001, "l", 5000), (5002, "under a loop", 5000), (6000, "d", 7000)]
    df = spark.createDataFrame(cats, "id long, name string, parent_id long")
    want = {(0, 1150): True, (3, 1199): True, (1199, 3): False, (7, 7): True, (1, 5002): True, (5000, 5001): True,
            (4, 6000): False, (4, 7000): False, (4, None): False, (4, 99999): False, (7000, 6000): True}
    props = spark.createDataFrame(list(want), "category_id long, new_parent_id long")
    got = {(r.category_id, r.new_parent_id): r.circular for r in tree.cycle_check(df, props).collect()}
    assert got == want
    ends = {r.start: (r.end, r.depth) for r in tree.walk_ends(df).collect()}
    assert ends[1199] == ("root", 1199) and ends[5002][0] == "loop" and ends[6000] == ("dangling", 1)


def _signups_one_by_one(users, invitations, signups):
    emails, admin_there = {u[0] for u in users}, any(u[1] == "admin" for u in users)
    used, out = {i[0]: i[3] for i in invitations}, {}
    by_id = {i[0]: i for i in invitations}
    for seq, email, token, at in sorted(signups, key=lambda s: (s[3], s[0])):
        if email in emails:
            out[seq] = "email_exists"
        elif token is not None:
            inv = by_id.get(token)
            if inv is None or (used[token] is not None and used[token] <= at) or inv[4] <= at:
                out[seq] = "invalid_or_expired"
            elif inv[1] != email:
                out[seq] = "email_mismatch"
            else:
                out[seq], used[token] = inv[2], at
                emails.add(email)
                admin_there = admin_there or inv[2] == "admin"
        elif admin_there:
            out[seq] = "admin_exists"
        else:
            out[seq] = "admin"
            emails.add(email)
            admin_there = True
    return out


def test_signups_equal_one_by_one(spark):
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    for seed in range(12):
        rng = random.Random(seed)
        users = [(f"u{i}", rng.choice(["agent", "admin"] if seed % 3 == 0 else ["agent"])) for i in range(3)]
        names = [f"u{i}" for i in range(9)]
        inv = [(i, rng.choice(names), rng.choice(["agent", "admin"] if seed % 2 else ["agent"]),
                rng.choice([None, None, day(rng.randrange(9))]), day(rng.randrange(4, 14))) for i in range(8)]
        su = [(i, rng.choice(names), rng.choice([None, *range(9)]), day(rng.randrange(8))) for i in range(30)]
        got = admin.signup_roles(
            spark.createDataFrame(users, "email string, role string"),
            spark.createDataFrame(inv, "id long, email string, role string, used_at timestamp_ntz, expires_at timestamp_ntz"),
            spark.createDataFrame(su, "seq long, email string, token_invitation_id long, attempt_at timestamp_ntz"))
        assert {r.seq: r.reason or r.role for r in got.collect()} == _signups_one_by_one(users, inv, su), seed


def _clients_one_by_one(clients, changes):
    phones, out = dict(clients), {}
    for seq, target, op, name, phone in sorted(changes):
        if op == "insert" and target in phones:
            out[seq] = "id_exists"
        elif op != "insert" and target not in phones:
            out[seq] = "not_found"
        elif op in ("insert", "name") and not (name or "").strip():
            out[seq] = "blank_name"
        elif op in ("insert", "phone") and phone is not None and any(p == phone and c != target for c, p in phones.items()):
            out[seq] = "phone_exists"
        else:
            out[seq] = None
            if op == "insert" or (op == "phone" and phone is not None):
                phones[target] = phone
    return out, phones


def test_client_changes_equal_one_by_one(spark):
    for seed in range(4):
        rng = random.Random(seed)
        clients = [(i, f"p{i}") for i in range(6)]
        ch = [(s, rng.randrange(10), rng.choice(["insert", "phone", "phone", "name", "deactivate"]),
               rng.choice(["n", "n", " "]), f"p{rng.randrange(9)}") for s in range(40)]
        df = spark.createDataFrame([(i, f"c{i}", p, None, None, True, None) for i, p in clients],
                                   "id long, name string, phone string, email string, company string, active boolean, created_at timestamp_ntz")
        cdf = spark.createDataFrame([(*c, None, None) for c in ch],
                                    "seq long, target_id long, op string, name string, phone string, email string, changed_at timestamp_ntz")
        new, decisions = admin.apply_client_changes(df, cdf)
        want, phones = _clients_one_by_one(clients, ch)
        assert {r.seq: r.reason for r in decisions.collect()} == want, seed
        assert {r.id: r.phone for r in new.collect()} == phones


def test_client_rounds_follow_the_phones_that_are_handed_on(spark, monkeypatch):
    """Held phones that many ask for take two rounds, however many ask; every phone handed on adds a few."""
    tables = []
    cut = admin.cut_lineage
    monkeypatch.setattr(admin, "cut_lineage", lambda df: tables.append(1) or cut(df))
    rng = random.Random(5)
    clients = [(i, f"p{i}") for i in range(8)]
    df = spark.createDataFrame(clients, "id long, phone string")
    kind = "seq long, target_id long, op string, name string, phone string"
    ch = [(s, 100 + s if s % 2 else rng.randrange(8), "insert" if s % 2 else "phone", "n", f"p{rng.randrange(8)}") for s in range(400)]
    got = {r.seq: r.reason for r in admin.client_decisions(df, spark.createDataFrame(ch, kind)).collect()}
    assert got == _clients_one_by_one(clients, ch)[0]
    assert len(tables) <= 5
    ch = [(s, s, "phone", None, f"p{s - 1}" if s else "new") for s in range(4)]
    got = {r.seq: r.reason for r in admin.client_decisions(df, spark.createDataFrame(ch, kind)).collect()}
    assert got == _clients_one_by_one(clients, ch)[0] == dict.fromkeys(range(4))
