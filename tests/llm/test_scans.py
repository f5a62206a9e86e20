"""Secret scan, URL filter, archives and decontamination on small odd tables."""

import gzip
import hashlib
import random
import re
import tempfile

from fieldseq.llm import archives, decontaminate, secrets, url_filter

KEY = "AKIA" + "Q7" * 8
SECRETS = [
    None, "", "nothing here", 'x token = "abcdefghijkl" y', "password: short", "API_KEY=" + "a1" * 20,
    "apikey=secret=abcdefghijklmnop", "api_key=mytoken : abcdefghijklmnop", f"é{KEY} and {KEY}x", "AKIA123",
    "0123456789abcdef" * 2, "0123456789abcde", "ghp_" + "Z9" * 18, "-----BEGIN RSA PRIVATE KEY-----",
    "eyJhbGciOiJI.eyJzdWIiOiIx", "🙂 passwd='0123456789abcdef0123'", "Token=" + "0a" * 4000, "toKEN:toKEN:abcdefghijkl",
]


def expected_spans(text):
    out = []
    patterns = [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12,
                 re.I | re.A), (r"AKIA[A-Z0-9]+", 0, 18, 0), (r"[0-9a-f]+", 0, 16, 0)]
    patterns += [(r.pattern, 0, 1, 0) for r in secrets.MORE]
    kinds = [r.kind for r in secrets.BASE + secrets.MORE]
    for n, (p, g, least, flags) in enumerate(patterns):
        out += [(m.start(), n, kinds[n], m.end()) for m in re.finditer(p, text or "", flags)
                if len(m.group(g)) >= least]
    return [(s, k, e) for s, _, k, e in sorted(out)]


def test_secret_spans_and_redaction(spark):
    rows = [(i if i != 4 else None, t, "z", "z") for i, t in enumerate(SECRETS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kinds string")
    got = secrets.scan(df).select("doc_id", "text", "kinds", "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.spans] == expected_spans(r.text), r.text
    for r in secrets.redact(secrets.scan(df)).collect():
        assert r.text is None or not (expected_spans(r.text) or KEY in r.text)
    clean = {r.text for r in secrets.redact(secrets.scan(df)).collect()}
    assert {"nothing here", "password: short", None, ""} <= clean
    assert secrets.scan(df.limit(0)).count() == 0


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.BASE + secrets.MORE}
    assert q["hex"] == [] and [set(a) for a in q["access"][0]] == [{"aki", "kia"}]
    assert {frozenset(("tok", "oke", "ken"))} <= set(q["assign"][0]) and len(q["assign"][0]) == 6
    assert q["private_key"] and q["jwt"] and q["google"]


def brute_ranks(edges, seeds, rounds=url_filter.ROUNDS, d=url_filter.DAMPING):
    """Walks over out-edges with mass returning to the seeds."""
    out, total = {}, sum(seeds.values())
    for (a, b), n in edges.items():
        out.setdefault(a, []).append((b, n))
    rank = dict(seeds)
    for _ in range(rounds):
        got = {}
        for a, v in rank.items():
            for b, n in out.get(a, []):
                got[b] = got.get(b, 0.0) + v * n / sum(x for _, x in out[a])
        moved = sum(got.values())
        new = {h: d * v for h, v in got.items()}
        for h, s in seeds.items():
            new[h] = new.get(h, 0.0) + s / total * (total - d * moved)
        rank = new
    return rank


def test_urls_rules_and_propagation(spark):
    def link(*hosts):
        return "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "http://a.ORG/x", link("friend.net")), (2, "https://www.example.org/es/1", ""),
        (3, "http://example.org/en/12?x", ""), (4, "http://example.org/en/2", None),
        (5, "http://b.com/de/", link("spam.net")), (6, "http://b.com/fr/", ""),
        (7, "http://spam.net/", link("bad.net", "x.com")), (8, "http://friend.net", link("third.net", "third.net")),
        (9, "http://third.net/?q=/fr/", ""), (10, None, ""), (11, "no scheme", link("bad.net")),
        (12, "http://pusher.net/", link("c.com")), (13, "http://c.com/de/1", ""), (13, "http://c.com/de/1", ""),
        (14, "http://notcom/fr/", ""), (15, "http://xexample.org/es/", ""), (16, "//a.org/x", ""),
        (17, "http://lonely.net/a#b", link("lonely.net"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert url_filter.judge(df).count() == len(rows)
    rules = {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "org/", 5: "com/de/", 6: "com/fr/",
             13: "com/de/", 15: "org/"}
    assert {i: r.rule for i, r in got.items() if r.rule} == rules
    assert [got[i].verdict for i in (1, 2, 3, 4, 5, 6, 13)] == [
        "allow", "block", "block", "allow", "block", "allow", "block"]
    assert (got[9].host, got[9].path) == ("third.net", "/") and got[10].host == got[16].host == ""
    assert got[8].path == "" and got[1].host == "a.org"
    # links from trusted hosts allow, links to blocked hosts block, unknown hosts are allowed
    assert [got[i].verdict for i in (7, 8, 9, 12, 10, 17)] == ["allow", "allow", "allow", "block", "allow", "allow"]
    pages = {}
    for i, u, h in dict.fromkeys(rows):
        pages.setdefault(got[i].host, set())
        pages[got[i].host] |= set(re.findall(r"//([^/]+)/x", h or "")) - {got[i].host}
    edges = {}
    for i, u, h in rows:
        for t in set(re.findall(r"//([^/]+)/x", h or "")) - {got[i].host}:
            if got[i].host:
                edges[got[i].host, t] = edges.get((got[i].host, t), 0) + 1
    ruled = [got[i] for i, _, _ in rows if got[i].rule]
    for verdict, name, way in (("allow", "trust", edges), ("block", "distrust", {(b, a): n for (a, b), n in edges.items()})):
        seeds = {}
        for r in ruled:
            if r.verdict == verdict:
                seeds[r.host] = seeds.get(r.host, 0) + 1 / len(ruled)
        want = brute_ranks(way, seeds)
        for r in got.values():
            assert abs(r[name] - want.get(r.host, 0.0)) < 1e-6, (name, r.host)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_propagation_goes_on_until_it_has_settled(spark):
    """A chain of 24 links, against far more rounds of the plain walk."""
    chain = {(f"h{i:02}", f"h{i + 1:02}"): 1 for i in range(24)}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in chain.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "h00", 1.0)], "kind string, host string, seed double")
    got = {r.host: r.value for r in url_filter.propagate(edges, seeds, 0.5, smallest=1e-8).collect()}
    want = brute_ranks(chain, {"h00": 1.0}, 400, 0.5)
    assert got["h23"] > 0 and all(abs(got[h] - v) < 1e-8 for h, v in want.items())
    assert 0.85 ** url_filter.ROUNDS < url_filter.SMALLEST


def test_archives_round_trip(spark):
    big, long = "é<p>\r\n\r\nWARC/1.1\r\n" * 20, "y" * 300_000
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (3, "http://a/2", big), (9, None, big), (1, "u", "small"),
            (2, "u\r\nX: y", "small"), (4, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (10, "u", "z" * 99),
            (11, "u", "z" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = tempfile.mkdtemp(prefix="warc-") + "/out"
    archives.write_archives(df, path, per_file=4)
    raw = archives.read_archives(spark, path)
    full = {(r.page_id, r.html) for r in raw.filter("record_type = 'response'").collect()}
    assert full == {(3, big), (1, "small"), (2, "small"), (4, ""), (6, ""), (7, long), (10, "z" * 99), (11, "z" * 99),
                    (12, "z" * 100)}
    got = archives.resolve_revisits(raw).collect()
    assert len(got) == len(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(texts[r.page_id])
        assert r.payload_digest == hashlib.sha256(texts[r.page_id]).hexdigest()
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [
        (3, 3), (5, 3), (8, 7), (9, 3), (13, 12)]
    import glob
    assert all(gzip.open(f).read(8) == b"WARC/1.1" for f in glob.glob(path + "/*.gz"))
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids) and all(r.origin in ids for r in got if r.record_type == "revisit")
    archives.write_archives(df.limit(0), path + "2")
    assert archives.resolve_revisits(archives.read_archives(spark, path + "2")).count() == 0


def test_archive_files_are_bounded_in_bytes(spark, monkeypatch):
    """Long payloads lie apart, a few or one to a file; ids and urls may be missing; a digest may be everywhere."""
    import glob
    monkeypatch.setattr(archives, "CLASS_BYTES", (0, 1000, 10_000))
    rows = [(i, f"u{i}", chr(97 + i % 7) * (500 + i)) for i in range(40)]
    rows += [(100 + i, "m", f"{i}" * 4000) for i in range(9)] + [(200 + i, "l", f"{i}" * 50_000) for i in range(3)]
    rows += [(None, "n", "0" * 4000), (None, None, "q" * 4000), (None, None, "q" * 4000)]
    rows += [(1000 + i, "hot", "same " * 30) for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = tempfile.mkdtemp(prefix="warc-") + "/out"
    archives.write_archives(df, path, "2024-05-06T07:08:09Z", per_file=50, file_bytes=20_000)
    for f in glob.glob(path + "/*.gz"):
        with gzip.open(f) as file:
            sizes = [len(block) for _, block in archives._parse(file.read())]
        assert max(sizes) >= 10_000 and len(sizes) == 1 or sum(sizes) <= 20_000 + 150 * len(sizes), sizes
    got = archives.resolve_revisits(archives.read_archives(spark, path)).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    count = lambda kind: sum(r.record_type == kind for r in got)
    assert count("revisit") == 1 + 1 + 1499 and count("response") == len(rows) - 1501
    assert {r.refers_to for r in got if r.page_id is not None and r.page_id > 1000} == {1000}
    by = {(r.page_id, r.url): r for r in got}
    assert by[None, "n"].record_type == "revisit" and by[None, "n"].refers_to == 100 and by[None, "n"].payload_bytes == 4000


def items_and_docs(rng):
    words = [f"t{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 60))) +
              (". " + " ".join(rng.choice(words) for _ in range(6)) if i % 2 else "")) for i in range(40)]
    docs = []
    for d in range(80):
        w = [rng.choice(words) for _ in range(rng.choice((0, 5, 80, 700)))]
        if d % 3 == 0:
            i = rng.randrange(40)
            at = rng.randrange(len(w) + 1)
            w[at:at] = items[i][1].upper().split()
        docs.append((d, " ".join(w)))
    return items, docs


def test_block_max_search_equals_all_scores():
    import numpy as np
    import pyarrow as pa

    from fieldseq.llm.words import words
    rng = random.Random(2)
    items, _ = items_and_docs(rng)
    h, owner = words(pa.array([t for _, t in items], pa.large_string()))
    df = {}
    for w in {(int(o), int(x.astype(np.int64))) for o, x in zip(owner, h)}:
        df[w[1]] = df.get(w[1], 0) + 1
    index = decontaminate.build_index([i for i, _ in items], [t for _, t in items], df, 40, len(h) / 40)
    for _ in range(60):
        terms = np.unique(np.array([rng.randrange(len(index.terms)) for _ in range(60)]))
        scores = np.zeros(40)
        for t in terms:
            for p in range(index.start[t], index.start[t + 1]):
                scores[index.items[p]] += index.impact[p]
        for bar in (0.05, 0.2, 0.4):
            got = dict(index.wand(terms, bar, 0, 40))
            assert set(got) == set(np.flatnonzero(scores >= bar).tolist())
            assert all(abs(v - scores[k]) < 1e-9 for k, v in got.items())
            assert set(dict(index.wand(terms, bar, 10, 20))) == {k for k in got if 10 <= k < 20}


def test_leaks_are_found_and_clean_texts_left(spark, monkeypatch):
    rng = random.Random(4)
    items, docs = items_and_docs(rng)
    held = {(d, i) for d, t in docs for i, x in items if " ".join(x.lower().split()) in t.lower()}
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1])]
    held |= {(102, i) for d, i in held if d == 0}
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, hits int")
    given = spark.createDataFrame(items + [(None, "x y"), (90, None), (91, " ")], "item_id long, text string")
    one = decontaminate.find_items(df, given)
    assert one.count() == len(docs) and one.columns == ["doc_id", "text", "hits"]
    pairs = {(r.doc_id, h.item_id) for r in one.collect() for h in r.hits}
    assert pairs == held and len(held) > 20
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 15)  # several indexes, the same hits
    more = decontaminate.find_items(df, given)
    assert {(r.doc_id, h.item_id) for r in more.collect() for h in r.hits} == held
    assert decontaminate.find_items(df.limit(0), given).count() == 0
    assert all(not r.hits for r in decontaminate.find_items(df, given.limit(0)).collect())


def test_hits_do_not_depend_on_the_number_of_passes(spark, monkeypatch):
    """One long item widens the passages of all others alike, in one index or several."""
    rng = random.Random(6)
    items, docs = items_and_docs(rng)
    items.append((77, " ".join(f"long{i}" for i in range(900))))
    for d in range(0, 30, 3):  # question and answer lie far apart
        i = 1 + 2 * rng.randrange(19)
        question, answer = items[i][1].rsplit(". ", 1)
        docs.append((200 + d, " ".join([question, *(f"x{rng.randrange(99)}" for _ in range(60 * (d + 1))), answer])))
    docs.append((300, "a b " + items[-1][1] + " c"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    given = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for n in (1000, 25, 9):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", n)
        found.append(sorted((r.doc_id, [(h.item_id, round(h.score, 9), h.first_word) for h in r.hits])
                            for r in decontaminate.find_items(df, given).collect()))
    assert found[0] == found[1] == found[2] and (300, 77) in {(d, h[0]) for d, hits in found[0] for h in hits}
