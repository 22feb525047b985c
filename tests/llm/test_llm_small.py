"""Operators against plain versions on small tables with the odd cases."""

import base64
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import (common, decontaminate, embeddings, html_text, minhash, packing, substrings, token_files, tokens,
                       toxicity, url_filter, warc)

DOCS = "doc_id long, text string, host string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in texts], DOCS).repartition(3)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Null, empty, one word, long, copies, near copies, chains of near copies, shared passages."""
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one"), (5, "One two"), (6, "one TWO")]
    base = prose(1, 300)
    for i in range(30):  # drifts away from the first step by step
        base = base[:]
        for k in range(6):
            base[(i * 37 + k * 41) % 300] = f"x{i}_{k}"
        out.append((100 + i, " ".join(base)))
    passage = prose(2, 60)
    for i in range(20):
        out.append((200 + i, " ".join([*prose(10 + i, 40), *passage, *prose(50 + i, 30)])))
    out += [(300 + i, " ".join(prose(3, 120))) for i in range(5)]
    out.append((400, " ".join([*passage, *passage])))
    out.append((401, " ".join(prose(4, 20_000, 5000))))
    out.append((402, "same " * 100))
    return out


def test_components_match_union_find(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 500)] + \
        [(2000 + i, 2001 + i) for i in range(120)]
    got = {x["node"]: x["component"] for x in common.components(
        spark.createDataFrame(links, "src long, dst long").repartition(7)).collect()}
    nodes = {n for e in links if e[0] != e[1] for n in e}
    assert got == roots(nodes, [e for e in links if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("size, block", [(2, 8), (5, 512)])
def test_minhash_matches_all_pairs(spark, texts, size, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(spark, texts), size=size).collect()}
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 20


def test_minhash_texts_of_one_shingle_length(spark):
    rows = [(1, "same same"), (2, "same same same"), (3, "Same " * 5), (4, "same"), (5, "a b"), (6, "a b a b"), (7, "a b a")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows), size=2).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 4), 5: (1, 5), 6: (2, 6), 7: (2, 6)}
    five = minhash.near_duplicates(docs_of(spark, [(1, "x " * 5), (2, "x " * 9), (3, "x " * 4)]), size=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in five} == {1: 1, 2: 1, 3: 3}


def test_minhash_empty(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def plain_removal(texts, window):
    seen = {}
    words = [(t or "").encode().split() for _, t in texts]
    for n, w in enumerate(words):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s:s + window]), []).append((n, s))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for n, s in places:
                gone[n].update(range(s, s + window))
    return [[x for k, x in enumerate(w) if k not in g] for w, g in zip(words, gone)]


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings_match_plain_version(spark, texts, hot):
    small, removals = substrings.repeated_passages(docs_of(spark, texts), window=35, hot=hot)
    partly = {r["doc_id"]: r for r in substrings.digest_removals(removals).collect()}
    kept = plain_removal(texts, 35)
    n = 0
    for r in small.collect():
        at = [i for i, _ in texts].index(r["doc_id"])
        want = (r["n_words"] - len(kept[at]), hashlib.sha256(b" ".join(kept[at])).hexdigest())
        if r["gone"]:
            got = (r["n_words"], hashlib.sha256(b"").hexdigest())
        elif r["doc_id"] in partly:
            got = tuple(partly[r["doc_id"]][c] for c in ("n_removed", "kept_sha256"))
        else:
            got = (0, r["sha"])
        assert got == want, r["doc_id"]
        n += want[0] > 0
    assert n >= 26


def test_remove_repeated_keeps_rows_and_columns(spark, texts):
    docs = docs_of(spark, texts)
    out = substrings.remove_repeated(docs)
    assert out.columns == docs.columns
    kept = dict(zip((i for i, _ in texts), plain_removal(texts, 35)))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(texts) and rows[0]["text"] is None and rows[2]["text"] == " \t\n"
    assert all((r["text"] or "").split() == [w.decode() for w in kept[i]] for i, r in rows.items())
    assert substrings.remove_repeated(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoder_is_the_tokenizer(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)  # as the library gives it, special strings in a text included
    enc = tokens.TextEncoder(path, cache_pieces=50)  # so small that it forgets
    r = random.Random(1)
    made = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|startoftext|>b", "x <|endoftext|", "<|endoftext|", "<<|endoftext|>>", "", " "]
    for _ in range(600):
        made.append("".join(r.choice(["a", "bc", "É", "ß", "Thon", " ", " ", "\n", "  ", "'s", ".", ",", "12", "\t", "漢", "İ", "Σ",
                                      "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<", "é", "\x1c"]) for _ in range(r.randrange(25))))
    for text in made:
        assert enc.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert enc.encode(None).tolist() == []


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for n, top, p in itertools.product((0, 1, 127, 128, 129, 5000), (1, 2, 50_000, 1 << 32), (0.5, 0.9, 1.0)):
        ids = r.integers(0, top, n, dtype="uint64").astype("uint32")
        ids[::17] = 0
        index, data = token_files.pack_blocks(ids, p)
        assert (token_files.unpack_blocks(index, data, -(-n // token_files.BLOCK), n) == ids).all()


def test_token_files_read_back(spark, texts):
    tokenizer, path = public_tokenizers.path("word_bpe_49k.json"), common.shared_path(spark, "t")
    token_files.write_token_files(docs_of(spark, texts), path, tokenizer, 2, segment_tokens=3000)
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, path).collect()}
    plain, at = Tokenizer.from_file(tokenizer), 0
    for i, t in sorted(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing_places_every_id_once(spark, texts):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs_of(spark, texts), tokenizer, 0, capacity=256).collect()
    plain = Tokenizer.from_file(tokenizer)
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, size in [(p, len(ids[i])) for i, p in by_doc.items()] + [(p, None) for p in by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size if size else at <= 256
    assert set(by_doc) == set(ids)
    assert len(by_sequence) <= 1.02 * sum(map(len, ids.values())) / 256 + 1


def test_plan_is_complete_and_tight():
    r = random.Random(3)
    for n in (1, 7, 300, 20_000):
        histogram = {}
        for _ in range(n):
            k = min(256, 1 + int(r.expovariate(1 / 60)))
            histogram[k] = histogram.get(k, 0) + 1
        used = {}
        plan = packing.plan_sequences(histogram, 256)
        for items, copies in plan:
            assert copies > 0 and sum(k * m for k, m in items) <= 256
            for k, m in items:
                used[k] = used.get(k, 0) + m * copies
        assert used == histogram
        least = math.ceil(sum(k * v for k, v in histogram.items()) / 256)
        assert sum(c for _, c in plan) <= 1.01 * least + 1


ARC = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def arc(version, records):
    head = f"{version} 0 test\n{warc.ARC_FIELDS[version]}\n".encode()
    out = b"filedesc://a%d.arc 0.0.0.0 19990102030405 text/plain %d\n" % (version, len(head)) + head + b"\n"
    more = b" 200 - - 0 a.arc" if version == 2 else b""
    for url, date, body in records:
        out += b"%s 1.2.3.4 %s text/html%s %d\n" % (url, date, more, len(body)) + body + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lengths_rule(version):
    tricky = ARC + b"http://x 1.2.3.4 20000101000000 text/html 5\nhello\nWARC/1.1\r\n\r\n"
    got = list(warc.parse_arc(arc(version, [(b"http://a/", b"19991231235959", tricky), (b"dns:a", b"20000101", b"")])))
    assert [g[2]["URL"] for g in got] == [f"filedesc://a{version}.arc", "http://a/", "dns:a"]
    assert got[1][3] == tricky and got[2][3] == b""
    with pytest.raises(ValueError):
        list(warc.parse_arc(arc(version, [(b"u", b"20000101", b"abc")])[:-3]))


def test_warc_round_trip(spark):
    pay = [b"same", b"same", b"", b"", b"\xff\xfe raw", b"same WARC/1.1\r\n\r\n"]
    data = arc(1, [(b"http://a/%d" % i, b"20000101000000", ARC + p) for i, p in enumerate(pay)] + [(b"dns:x", b"1999", b"10")])
    src, out = common.shared_path(spark, "a"), common.shared_path(spark, "w")
    warc.write_files(spark.createDataFrame([(bytearray(data),)], "content binary"), src)
    records = common.stage(warc.convert_arcs(spark, src), "r")
    keys = records.where("warc_type = 'response'")
    refers = warc.first_of_payload(keys.select("rec_id", "target_uri", "payload_bytes", "payload_digest"), "target_uri")
    warc.write_warc(records.join(refers, "rec_id", "left"), out, file_bytes=300)
    rows = warc.read_warc(spark, out).collect()
    by_uri = {r["target_uri"]: r for r in rows}
    assert len(rows) == 8 and by_uri["filedesc://a1.arc"]["warc_type"] == "warcinfo"
    assert by_uri["dns:x"]["warc_type"] == "resource" and by_uri["dns:x"]["warc_date"] == "1999-01-01T00:00:00Z"
    for i, p in enumerate(pay):
        r = by_uri[f"http://a/{i}"]
        assert r["payload_bytes"] == len(p)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = pay.index(p)
        assert r["refers_to_id"] == (None if first == i else by_uri[f"http://a/{first}"]["rec_id"])


def test_embeddings_match_all_pairs(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16))
    rows = []
    for i in range(600):
        v = centres[r.integers(40)] + r.normal(size=16) * 0.12
        rows.append((i, [float(x) for x in v.astype("float32")], None if i % 50 == 0 else int(i % 3)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 16, 1), (2004, [1.0, 2.0], 1),
             (2005, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {x["vec_id"]: x for x in embeddings.near_vectors(df, least_pivots=8, block_rows=64).collect()}
    links, count = [], dict.fromkeys((x[0] for x in rows), 0)
    unit = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            unit[i] = (label, np.array(v) / np.linalg.norm(np.array(v)))
    for a, b in itertools.combinations(unit, 2):
        if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98:
            links.append((a, b))
            count[a] += 1
            count[b] += 1
    assert len(links) > 1000 and len(got) == len(rows)
    found = sum(min(x["n_links"], count[i]) for i, x in got.items()) / sum(count.values())
    assert found >= 0.99 and all(x["n_links"] <= count[i] for i, x in got.items())
    want = roots(count, links)
    assert sum(x["component_id"] == want[i] for i, x in got.items()) >= 0.99 * len(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


PAGE = ('<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>no";</script></head><body class="has-sidebar"><nav><ul><li>'
        '<a href="/">Home {n}</a></ul></nav><div id="cookie-notice">We use<br>cookies</div>{body}<aside>more</aside>'
        '<div class="comments"><article>nice</article></div><footer>&copy; {n}</footer></body></html>')


def test_html_text(spark):
    article = ('<article class="post"><header><h1>Big  &amp;\n small</h1></header><p><b>First<br><p>Second <i>it</i>alic'
               '<div class="ad">buy</div><form>x</form><div class="comments"><p>me too</p></div><p>caf&eacute; &#8364;</article>')
    want = "Big & small\nFirst\nSecond italic\ncafé €"
    rows = [(1, "http://a.org/x/1", PAGE.format(n=1, body=article)), (2, "http://a.org/x/2", PAGE.format(n=2, body=article)),
            (3, "http://b.org/x/1", PAGE.format(n=3, body="<div><p>Template line</p><p>Only here</p></div>")),
            (4, "http://b.org/x/2", PAGE.format(n=4, body="<div><p>Template line</p><p>Another text</p></div>")),
            (5, None, None), (6, "no scheme", ""), (7, "http://c.org/", article[:60])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[1]["text"] == got[2]["text"] == want
    # Without article elements the differencing decides.
    assert got[3]["text"] == "Only here" and got[4]["text"] == "Another text"
    assert got[5]["text"] == got[6]["text"] == "" and got[7]["text"] == "Big & small"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_text_of_copies_without_article(spark):
    body = lambda words, more="": "<div><p>Template line</p>" + "".join(f"<p>{w} {w}</p>" for w in words) + f"{more}</div>"
    want = lambda words: "\n".join(f"{w} {w}" for w in words)
    a, b, c = ([f"{x}{w}" for w in prose(70 + i, 30, 5000)] for i, x in enumerate("abc"))
    rows = [(i, f"http://a.org/x/{i:03}", PAGE.format(n=i, body=body(a))) for i in range(60)]  # one group, many ranges
    rows += [(i, f"http://a.org/x/{i:03}", PAGE.format(n=i, body=body(b, f"<p>{i}</p>"))) for i in range(60, 90)]  # nearly equal
    rows += [(90, "http://a.org/y", PAGE.format(n=90, body=body(c)))]
    rows += [(i, f"http://b.org/{i}", PAGE.format(n=i, body=body(c))) for i in range(100, 120)]  # nothing else on the host
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {i: want(a) for i in range(60)} | {i: want(b) + f"\n{i}" for i in range(60, 90)} | {90: want(c)} | {
        i: "Template line\n" + want(c) for i in range(100, 120)}


def test_common_lines_is_longest():
    r = random.Random(0)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        c, rest = html_text.common_lines(a, b), iter(b)
        assert len(c) == t[-1][-1] and all(any(a[i] == y for y in rest) for i in c)


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.org/es/x?q", "https://org", "ftp://x.com/fr/", None, "no scheme", "http://bad.net/a", "http://good.net/a"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + i, f"http://bad.net/{i}") for i in range(60)] +
                                  [(300 + i, f"http://good.net/{i}") for i in range(60)], "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + i, 1, "h") for i in range(60)] + [(300 + i, 0, "h") for i in range(60)] +
                                     [(0, None, "h")], "page_id long, bad int, host string")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/")]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, outcomes, rules).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("org", "", None, "allow") and got[2] == ("x.com", "/fr/", "com/fr/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][3] == "block" and got[6][3] == "allow"
    assert url_filter.judge_urls(pages.limit(0), outcomes.limit(0), rules).count() == 0


def test_decontamination(spark):
    item = prose(7, 40)
    changed = item[:]
    changed[20] = "other"
    items = spark.createDataFrame([(1, " ".join(item)), (2, "a b"), (3, None), (4, "!!"), (5, " ".join(prose(8, 30)))],
                                  "item_id long, text string")
    rows = [(1, " ".join(prose(20, 50) + item + prose(21, 50))), (2, " ".join(prose(22, 50) + changed)),
            (3, " ".join(w.upper() + "," for w in item)), (4, " ".join(item[:20])), (5, None), (6, ""), (7, "x a b y"),
            (8, " ".join(prose(23, 3000, 5000))), (9, " ".join(item * 3))]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs_of(spark, rows), items).collect()}
    assert set(got) == {(1, 1), (3, 1), (7, 2), (9, 1)} | ({(2, 1)} & set(got))
    assert got[1, 1]["similarity"] == 1.0 and got[1, 1]["start"] == 50 and got[7, 2]["start"] == 1
    assert decontaminate.contaminated(docs_of(spark, rows), items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(spark, []), items).count() == 0


def test_decontamination_of_swapped_parts(spark):
    """Against all item-sized windows, without fingerprints."""
    a, b, c = prose(30, 80, 5000), prose(31, 160, 5000), prose(32, 100, 5000)
    items = [(1, a), (2, b), (3, c), (4, prose(33, 6))]
    around = lambda i, w: prose(40 + i, 70, 5000) + w + prose(60 + i, 90, 5000)
    rows = [(1, around(1, a[40:] + a[:40])), (2, around(2, b[80:] + b[:80])), (3, around(3, c[50:75] + c[75:] + c[:50])),
            (4, around(4, a[40:] + prose(34, 100, 5000) + a[:40])), (5, a[40:] + a[:40]), (6, b[100:] + b[:100] + prose(35, 30, 5000)),
            (7, around(7, prose(36, 30, 5000) + c[66:] + c[33:66] + c[:33])), (8, around(8, b))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in
           decontaminate.contaminated(docs_of(spark, [(i, " ".join(w)) for i, w in rows]), df).collect()}
    grams = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    held = {}
    for _, w in items:
        for g in set(grams(w)):
            held[g] = held.get(g, 0) + 1
    weigh = lambda w: {g: grams(w).count(g) * round(1000 * math.log1p(len(items) / held.get(g, 1))) for g in grams(w)}
    want = {}
    for (i, w), (j, x) in itertools.product(rows, items):
        whole = weigh(x)
        for s in range(len(w) - len(x) + 1):
            mine = weigh(w[s:s + len(x)])
            common = sum(min(v, whole.get(g, 0)) for g, v in mine.items())
            union = sum(mine.values()) + sum(whole.values()) - common
            if 100 * common >= 80 * union:
                want.setdefault((i, j), []).append((s, common / union))
    assert set(got) == set(want) == {(1, 1), (2, 2), (3, 3), (5, 1), (6, 2), (7, 3), (8, 2)}
    for p in got:
        assert got[p][1] == pytest.approx(max(x for _, x in want[p]))
        assert got[p][0] in [s for s, _ in want[p]]
    assert got[8, 2] == (70, 1.0)


def test_fingerprints_within_the_radius_share_a_block(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randrange(decontaminate.RADIUS + 1)):
            y ^= 1 << b
        rows.append((i, *(v - (1 << 64) if v >> 63 else v for v in (x, y))))
    df = spark.createDataFrame(rows, "i long, x long, y long")
    a = df.select("i", decontaminate.blocks("x").alias("b"))
    b = df.select("i", decontaminate.blocks("y").alias("b"))
    assert a.join(b, ["i", "b"]).select("i").distinct().count() == 300


def test_toxicity_on_held_out_labels(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words, bad, junk = prose(1000 + i, 60), i % 5 == 0, i % 7 == 0
        if bad:
            words[r.randrange(60)] = r.choice(["nastyish", "nastyly", "nastyous", "nastyful", "nastyard", "vileness"])
        rows.append((i, " ".join(words).upper() if junk else " ".join(words)))
        labels.append((i, int(junk), None if i % 90 == 0 else int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "nastyest thing")]
    docs = docs_of(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit_chain(docs, known.where("doc_id < 600"), ["low_quality", "toxic"], train_rows=600)
    got = {x["doc_id"]: x for x in toxicity.score(docs, chain).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["rejected"], i % 5 == 0) for i in range(600, 900)]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert got[1002]["rejected"] and not got[1000]["rejected"]
    assert toxicity.without_rejected(docs, chain).columns == docs.columns
    none = toxicity.fit_chain(docs, known.limit(0), ["low_quality", "toxic"])
    assert toxicity.without_rejected(docs, none).count() == len(rows)


def test_logistic_reaches_the_optimum():
    r = np.random.default_rng(0)
    n, rows, cols = 400, [], []
    x = (r.random((n, 6)) < 0.3)
    y = (r.random(n) < 1 / (1 + np.exp(-(x @ np.array([2, -1, 0.5, 0, 1, -2]) - 0.3)))).astype("float64")
    rows, cols = np.nonzero(x)
    w = toxicity.fit_logistic(rows, cols, r.normal(size=(n, 5)), y, 6, 1e-3, 1e-2)
    assert abs(w[1] - 2) < 0.8 and abs(w[6] + 2) < 0.9
    assert toxicity.best_cutoff([(0.9, 5, 5), (0.1, 0, 20)]) == 0.5 and toxicity.best_cutoff([]) == 2.0


def test_entry_registers_the_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, step in p.STAGES[:-1]:
        docs = common.stage(step(spark, docs, sf), name)
        assert docs.columns == columns
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= ids
        ids = set(now)
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
