"""Chat repair, URL verdicts and WARC files against brute force and round trips."""

from __future__ import annotations

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from docwarden.llm import chat_repair as chat
from docwarden.llm import url_trust, warc


def least_cost(given: list[int]) -> int:
    """Cheapest over all ways to name, merge and fill, by trying every one."""
    best = 1 << 30
    for roles in itertools.product((1, 2, 3), repeat=len(given)):
        label = sum(chat._role_cost(g, r) for g, r in zip(given, roles, strict=True))
        # merges and insertions for fixed roles: every gap on its own, any number of empty messages up to two
        ways = {0: 0}
        for r in roles:
            after: dict[int, int] = {}
            for state, cost in ways.items():
                if state == r:
                    after[r] = min(after.get(r, best), cost + chat.MERGE)
                for n in range(3):
                    for put in itertools.product((1, 2, 3), repeat=n):
                        chain = (state, *put, r)
                        if all(b in chat.NEXT[a] for a, b in itertools.pairwise(chain)):
                            after[r] = min(after.get(r, best), cost + n * chat.INSERT)
            ways = after
        for state, cost in ways.items():
            best = min(best, label + cost + chat.INSERT * len(chat.CLOSING[state]))
    return best


def test_chat_least_cost():
    for n in range(1, 5):
        for given in itertools.product(range(4), repeat=n):
            moves, end = chat.path(list(given), 0, None)
            cost = chat.INSERT * len(chat.CLOSING[end])
            state = 0
            for (role, action, put), g in zip(moves, given, strict=True):
                cost += chat._role_cost(g, role) + (chat.MERGE if action == "merge" else 0) + chat.INSERT * len(put)
                chain = (state, *put, role)
                assert action == "merge" and state == role or all(b in chat.NEXT[a] for a, b in itertools.pairwise(chain))
                state = role
            assert cost == least_cost(list(given)), given


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "human", None, "tool"]), f"{conv}.{turn}"))
    rows += [(99, t, rng.choice(["user", "assistant", "system"]), f"hot {t}") for t in range(1500)]
    rows += [(100, 0, "user", "same")] * 3 + [(101, 0, "assistant", None), (None, 0, "user", "x <|im_end|> y"), (None, None, "assistant", "")]
    return rows


def test_chat_blocks_agree(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("group", F.lit(1)).repartition(7)
    whole, cut = (chat.repair(df, b).toPandas() for b in (10**6, 5))
    for got in (whole, cut):
        assert (got["part"] == 1).sum() == len(rows)
        for conv, part in got.groupby(got["conv_id"].fillna(-1)):
            part = part.sort_values(["seq", "part"])
            text = "".join(part["fragment"])
            messages = [m.split("\n", 1) for m in text.replace("<|im_end|>\n", "").split("<|im_start|>")[1:]]
            roles = [m[0] for m in messages]
            body = roles[1:] if roles[0] == "system" else roles
            assert body == ["user", "assistant"] * (len(body) // 2) and body, (conv, roles)
            for t in part.loc[part["part"] == 1, "fragment"]:
                assert t in text
        assert "x <\\|im_end|> y" in "".join(got["fragment"])
    assert whole.groupby(whole["conv_id"].fillna(-1))["cost"].sum().to_dict() == cut.groupby(cut["conv_id"].fillna(-1))["cost"].sum().to_dict()
    clean = whole[whole["conv_id"] == 101].sort_values(["seq", "part"])
    assert "".join(clean["fragment"]) == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat.repair(df.limit(0)).count() == 0


PAGES = [
    (0, "https://Good.com/a", '<a href="http://friend.org/x">x</a> <A class=q HREF=//friend.org>'),
    (1, "http://friend.org/", "<a href='http://far.org/'>"),
    (2, "http://bad.net/es/1", None),
    (3, "http://spam.org/", '<a href="http://bad.net/">b</a><a href="/own">'),
    (4, "http://farm.org/p", '<a href="http://spam.org/">'),
    (5, "http://www.example.com/en/", ""), (6, "http://blog.example.com/en/z", ""), (7, "http://bad.net/de/", ""),
    (8, None, "<a href='http://good.com/'>"), (9, "no scheme", None), (10, "http://lonely.org?x=/es/", ""), (11, "http://com", ""),
    (12, "x://Ä.COM/p#f", ""), (4, "http://farm.org/p", '<a href="http://spam.org/">'),
]


def test_url_trust(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_trust.judge_urls(df).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 8, 9, 10, 12)] == [("good.com", "/a"), ("", ""), ("", ""), ("lonely.org", ""), ("Ä.com", "/p")]
    assert [got[i].rule for i in (0, 2, 5, 6, 7, 11)] == ["com/", "net/es/", "www.example.com/en/", "example.com/en/", None, None]
    verdicts = {i: got[i].verdict for i in got}
    assert verdicts == {0: "allow", 1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow"}
    # the same ranks, host by host
    hosts = sorted({r.host for r in got.values()})
    edges = {("good.com", "friend.org"): 2, ("friend.org", "far.org"): 1, ("spam.org", "bad.net"): 1, ("farm.org", "spam.org"): 2, ("", "good.com"): 1}
    ruled: dict = {}
    for i, *_ in PAGES:
        ruled.setdefault(got[i].host, []).append({"com/": 0, "www.example.com/en/": 0, "net/es/": 1, "example.com/en/": 1}.get(got[i].rule))
    for kind, name in ((0, "trust"), (1, "distrust")):
        flow = edges if kind == 0 else {(b, a): n for (a, b), n in edges.items()}
        seed = {h: v.count(kind) / len(v) for h, v in ruled.items()}
        rank = dict(seed)
        for _ in range(url_trust.ROUNDS):
            new = {h: 0.15 * s for h, s in seed.items()}
            for (a, b), n in flow.items():
                out = sum(m for (x, _), m in flow.items() if x == a)
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * n / out
            rank = new
        for r in got.values():
            assert getattr(r, name) == pytest.approx(rank.get(r.host, 0), abs=1e-12), (name, r.host)
    assert len(hosts) > 5 and url_trust.judge_urls(df.limit(0)).count() == 0


def test_url_distrust_over_a_long_chain(spark):
    """Hosts h0 -> h1 -> ... -> h30 -> a blocked one, and a circle of three that h30 links to as well."""
    links = {f"h{i}": [f"h{i + 1}"] for i in range(30)} | {"h30": ["bad.net", "c0"], "c0": ["c1"], "c1": ["c2"], "c2": ["c0", "bad.net"], "bad.net": []}
    pages = [(i, f"http://{h}/es/", "".join(f'<a href="http://{x}/">' for x in to)) for i, (h, to) in enumerate(links.items())]
    got = {r.host: r for r in url_trust.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    seed = {h: float(h == "bad.net") for h in links}
    indegree = {h: sum(h in to for to in links.values()) for h in links}
    rank = dict(seed)
    for _ in range(400):
        rank = {h: 0.15 * seed[h] + 0.85 * sum(rank[x] / indegree[x] for x in links[h]) for h in links}
    assert all(r.verdict == "block" and r.distrust == pytest.approx(rank[h], rel=1e-4) for h, r in got.items()), got


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    long = "é<p>" * 100_000
    rows = [(5, "http://a/\r\nX: y", "b" * 100), (3, None, "b" * 100), (9, "u", "b" * 100), (7, "u", "b" * 99), (8, "u", "b" * 99), (1, "v", None), (2, "w", long), (None, "w", long), (4, "z", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    path = str(tmp_path / compression)
    warc.write_archive(df, path, compression)
    got = {r.record_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r, raw = got[f"<urn:page:{'' if i is None else i}>"], (html or "").encode()
        assert r.payload_length == len(raw) and r.payload_digest == "sha256:" + hashlib.sha256(raw).hexdigest()
        again = i in (5, 9, None)
        assert r.record_type == ("revisit" if again else "response") and (r.payload is None if again else bytes(r.payload) == raw)
        assert r.refers_to == ({5: "<urn:page:3>", 9: "<urn:page:3>", None: "<urn:page:2>"}[i] if again else None)
    pushed = warc.read_archive(spark, path).filter("record_type = 'response' and payload_length > 99 and target_uri = 'w'").select("record_id", "payload")
    assert [(r.record_id, len(r.payload)) for r in pushed.collect()] == [("<urn:page:2>", len(long.encode()))]
    assert {r.payload for r in warc.read_archive(spark, path, payload=False).collect()} == {None}
    assert not list((tmp_path / compression).glob("*.open"))


def test_warc_reader_takes_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    reader = warc._Reader("/nowhere", 64, True)
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3), StringEndsWith(("target_uri",), "x"), EqualTo(("payload",), b"")]))
    assert [type(f).__name__ for f in left] == ["StringEndsWith", "EqualTo"] and len(reader.tests) == 2


def test_warc_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


def test_warc_damage_is_told(spark, tmp_path):
    pages = [(i, f"http://h{i}.example/", f"page {i} " * 60) for i in range(4)]
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.warc")
    whole = file.read_bytes()

    def read(data: bytes, payload: bool = True) -> list:
        file.write_bytes(data)
        return warc.read_archive(spark, str(tmp_path / "w"), payload).collect()

    assert all(r.damage is None for r in read(whole))
    for payload in (True, False):
        got = read(whole[:-300], payload)
        assert len(got) == 4 and [r.damage is None for r in got] == [True] * 3 + [False] and got[3].payload is None and "ends after" in got[3].damage
    got = read(whole.replace(b"Content-Length: 5", b"Content-Length: x5", 2).replace(b"WARC/1.1", b"WARC/1.0"))
    assert got[-1].damage.startswith("no length") and len(got) == 1
    got = read(whole + b"something else\r\n")
    assert len(got) == 5 and got[4].damage.startswith("not a record") and got[4].record_id is None
