"""Operators on single texts: decontamination, personal data, URL filter, tokens and files."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from edge import TEXTS, documents
from patronlens.llm import decontaminate, pack, pii, rans, tokens, urls


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_hits(text, items, window=10):
    words, covered, ids = plain_words(text), set(), set()
    for item, body in items:
        own = plain_words(body)
        size = min(window, len(own))
        for at in range(len(own) - size + 1) if own else []:
            for here in range(len(words) - size + 1):
                if words[here : here + size] == own[at : at + size]:
                    covered.update(range(here, here + size))
                    ids.add(str(item))
    return len(words), len(covered), sorted(ids)


ITEMS = [
    (1, "Brown FOX jumps over the lazy dog and runs far"),
    (2, "jumps over the lazy dog and runs far away today and tomorrow"),
    (3, "one"),
    (4, ""),
    (5, None),
    (3, "école İstanbul"),
    (20, "word word word word word word word word word word word"),
]


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_hits_match_plain_search(spark, most):
    docs = documents(spark, clash="id words n hits item")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'y' AS items", "2 AS gram")
    found = decontaminate.find_hits(docs, bench, max_broadcast_bytes=most).collect()
    wanted = [(i or -1, *plain_hits(t[:3000] + " word end" if t and len(t) > 9999 else t, ITEMS)) for i, t in TEXTS]
    got = [(r.id or -1, r.n_words, r.n_hit, r.item_ids) for r in found]
    long = [g for g in got if g[0] == 9]
    assert long == [(9, 30_001, 30_000, ["20"])] * 2
    assert sorted(g for g in got if g[0] != 9) == sorted(w for w in wanted if w[0] != 9)


def test_contaminated_documents_go_and_spans_are_cut(spark):
    docs = documents(spark, clash="found_id text_hash")
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 4, 5, 6, 7, 8, 9, 9, 10]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[1] == "the quick " and cut[3] == "The Quick " and cut[7] == "one" and cut[4] is None


def test_empty_benchmark_and_no_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.find_hits(documents(spark), bench).collect()} == {0}
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_hits(documents(spark, []), items).collect() == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


PERSONAL = [
    "mail a@b.c@d.e or x@y.z_w@q.r, host 1.2.3.4.5.6.7.8 and 300.1.1.1 and 007.1.1.255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500005555555559.",
    "call +1 (555) 123-4567 or +44 20 7946 0958 or +1234567 or +1--------2",
    "é 😀 \x01jim@mail.example.com\x02 +1 555 010 9999",
    "12345678901234567890123 " + "1" * 20_000 + " " + "a" * 20_000 + "@ " + "9." * 2_000,
    "call 555-123-4567, jim [at] foo [dot] com",
    "nothing here at all, is there",
]


def test_base_spans_match_plain_search(spark):
    rows = [*TEXTS, *enumerate(PERSONAL, 50), (50, PERSONAL[0])]
    found = pii.report(documents(spark, rows, "kind start match gen")).collect()
    assert len(found) == len(rows)
    by_id = dict((i, t) for i, t in rows if i is not None)
    for r in found:
        if r.id is None:
            continue
        base = plain_spans(by_id[r.id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in BASE]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    spans = {r.id: r.spans for r in found}
    assert spans[55] == "email:19:41,phone:5:17"
    assert spans[56] == "" and spans[4] == ""


def test_long_addresses_are_selected_beside_the_base_forms(spark):
    rows = [(1, "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up"), (2, "at fe80:1:2:3:4:5:6:ABCD, or 1.2.3.4")]
    rows += [(3, "not 12001:db8:1:2:3:4:5:6 nor 00:1b:44:11:3a:b7")]
    found = {r.id: r for r in pii.report(documents(spark, rows)).collect()}
    assert found[1].spans == "ip:5:44" and "ip:29:36" in found[2].spans and found[3].spans == ""
    assert [found[i].n_ip for i in (1, 2, 3)] == [0, 1, 0]  # base forms alone


def test_spans_are_all_learned_from(spark, monkeypatch):
    """The trees get every span of a corpus with many; seeds only stand for forms that it lacks."""
    stored, rows = pii.stored, []

    def kept(df):
        rows.append(stored(df))
        return rows[-1]

    monkeypatch.setattr(pii, "stored", kept)
    spans = spark.range(9_000).selectExpr(
        "'ip' AS kind", "true AS base", "concat_ws('.', 1 + id % 200, id % 256, id div 256, 7) AS match",
        "concat('host ', id) AS before", "' is up' AS after",
    )
    model, thresholds = pii.train(spans)
    counts = {(r.kind, r.base): r["count"] for r in rows[-1].groupBy("kind", "base").count().collect()}
    assert counts["ip", True] == 5 * 9_000 and counts["ip", False] == 5 * pii.SEEDS and len(counts) == 8
    assert set(thresholds) >= {"ip", "email"}


def test_redacted_texts(spark):
    rows = [*enumerate(PERSONAL), (7, None), (8, ""), (None, PERSONAL[1])]
    docs = documents(spark, rows, "pii_spans pii_id")
    found = pii.redact(docs)
    assert found.columns == docs.columns
    out = {r.doc_id: r.text for r in found.collect()}
    assert out[1] == out[None] == "card [CARD] or 4111-1111-1111-1112, [CARD]."
    assert out[3] == "é 😀 \x01[EMAIL]\x02 [PHONE]"
    assert out[6] == PERSONAL[6] and out[7] is None and out[8] == ""


def test_no_documents_no_spans(spark):
    assert pii.report(documents(spark, [])).collect() == []
    assert pii.redact(documents(spark, [])).collect() == []


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=/es/", "http://org/", "http://org", "ftp://x.com/fr/#/de/",
    "http://x.com/de/", "http://evil.net/x.com/fr/", "http://notexample.org/es/", None, "no scheme", "",
    "://", "http://casino.net/", "http://x.net/Casino", "http://u@x.com:80/fr/", "a://b://c.org/x", "http://é.com/de/ü",
    "http://free-bets.example.org/es/", "http://x\n.com/fr/\ny", "http://" + "a" * 5000 + ".com/de/",
]


def plain_verdict(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = lower(host)
    fits = []
    for rule, verdict in urls.HOST_RULES:
        own, slash, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + tail):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(g.strip("*") in host + path for g in urls.BLOCK_GLOBS)
    return host, path, None, "block" if bad else "allow"


def test_urls_match_plain_rules(spark):
    frame = spark.createDataFrame([(i % 17, u) for i, u in enumerate(URLS)], "page_id long, url string")
    frame = frame.selectExpr("*", "'p' AS path", "cast(null as string) AS html")
    got = sorted(map(repr, map(tuple, urls.judge_urls(frame).collect())))
    assert got == sorted(repr((i % 17, *plain_verdict(u))) for i, u in enumerate(URLS))
    assert urls.judge_urls(frame.limit(0)).collect() == []


def test_automaton_on_globs():
    import fnmatch
    import random

    rng = random.Random(4)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["", "*"]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(200)]
    found = urls.Automaton.compile(globs).match([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert found[i].tolist() == [fnmatch.fnmatchcase(text, g) for g in globs]


def plain_ids(text):
    from tokenizers import Tokenizer

    tokenizer = plain_ids.__dict__.setdefault("own", Tokenizer.from_file(tokens.default_tokenizer()))
    return np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")


def test_ids_of_pieces_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 20)
    encoder = tokens.Encoder(tokens.default_tokenizer())
    odd = ["İ ΣΑΣ é\u0301 <|endoftext|>x ﬁ ＡＢ", "a\tb\xa0c d  e\r\nf 12.5, it's ŉ ǅ.", "...", ",", "Ünder. ÉCOLE, \u0301a"]
    for text in [*odd, *[t for _, t in TEXTS if t]]:
        assert encoder.encode(text) == plain_ids(text)[:-1].tobytes()


@pytest.mark.parametrize("capacity,part_rows", [(4096, 20_000), (16, 5)])
def test_packing(spark, capacity, part_rows):
    rows = [*TEXTS, *[(100 + i, "word " * (i % 14)) for i in range(60)]]
    found = pack.pack(documents(spark, rows, "piece row"), capacity=capacity, part_rows=part_rows, merge=2).collect()
    wanted = []
    for doc_id, text in rows:
        ids = plain_ids(text)
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted.append((doc_id or -1, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    bound = pack.lower_bound(np.array([r.length for r in found]), capacity)
    assert bound <= len(sequences) <= bound + max(1, bound // 20)


def test_lower_bounds_and_best_fit():
    assert pack.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert pack.lower_bound(np.array([4, 4, 4]), 10) == 2
    assert pack.lower_bound(np.array([], np.int64), 10) == 0
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = rng.integers(1, 11, 30)
        bins = pack.best_fit_decreasing(lengths, 10)
        fills = np.bincount(bins, weights=lengths)
        assert fills.max() <= 10 and len(fills) >= pack.lower_bound(lengths, 10)


def test_no_documents_no_pieces(spark):
    assert pack.pack(documents(spark, [])).collect() == []


@pytest.mark.parametrize("block_ids,lanes,checkpoint", [(1 << 18, 512, 256), (50, 4, 2)])
def test_files_give_back_all_ids(spark, tmp_path, block_ids, lanes, checkpoint):
    folder = str(tmp_path / "ids")
    rans.write_ids(documents(spark, clash="ids part"), folder, block_ids=block_ids, lanes=lanes, checkpoint=checkpoint)
    found = rans.read_ids(spark, folder, with_ids=True).collect()
    assert len(found) == len(TEXTS)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id or 0 for r in sorted(found, key=lambda r: r.start)] == sorted(i or 0 for i, _ in TEXTS)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in found)
    ids = [(i or 0, plain_ids(t)) for i, t in TEXTS]
    assert got == sorted((i, len(x), zlib.crc32(x.tobytes()), x.tobytes()) for i, x in ids)


def test_no_documents_no_files(spark, tmp_path):
    rans.write_ids(documents(spark, []), str(tmp_path / "ids"))
    assert rans.read_ids(spark, str(tmp_path / "ids")).collect() == []


def test_blocks_decode_in_parts_and_notice_damage():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.zipf(1.3, 200_000).clip(0, 49_000))
    table = rans.Table(rans.quantised(counts))
    ids = rng.choice(np.flatnonzero(counts), 70_001, p=counts[counts > 0] / counts.sum())
    data = rans.encode_block(ids, table, 64, 128)
    assert (rans.decode_block(data, table) == ids).all()
    parts = [rans.decode_block(data, table, k, k + 1) for k in range(9)]
    assert (np.concatenate(parts) == ids).all()
    with pytest.raises(ValueError):
        rans.decode_block(data[:500] + b"\0\1" + data[502:], table)
    few = rans.quantised(np.array([0, 3, 10**9, 1, 0, 1]))
    assert few.sum() == 1 << 20 and (few > 0).tolist() == [False, True, True, True, False, True]
