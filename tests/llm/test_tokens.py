"""Alignment, fill-in-the-middle and token files against brute force and whole texts."""

import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import align, fill_middle, id_coder, id_files, unit_tokens
from tidemill.llm.queries import op11_token_id_output, op12_cross_tokenizer_alignment, op13_fill_in_middle
from tidemill.llm.unit_tokens import byte_units, piece_units, vocabulary

STRANGE = [
    "don't it's we'll DON'T 'S", "ÄÖÜ ß é café", "tabs\tand hard spaces\x85next", "<|endoftext|> inside", "日本語 テキスト", "İstanbul ΑΣ", "x" * 500, "½²³ 12345", "\x1c\x1d odd \x1e",
    "a  b   c", " lead", "trail ", "trail\n", "\n\n a\n\n\nb \n c", "  ", " ", "\t\t x", "a　b   c", "a▁b", "<s>", "<0x0A>", "\x00 a", "'s", "!!' ll", "a 's", "é's l'été", "𝔘𝔫𝔦 😀 x", "a\xa0 b", "",
    "l'll 'llx 'Tx", "x_1 y-2,z", "<P> in <S> it", "a <P", "<M>", "S> <", "é combining", "Ω mixed Latin. And more!", "the cat.Sat! 日本 on-the_mat 12ab",
]


def whole(text):
    """Ids of A and B of whole texts."""
    a, b = byte_units(vocabulary("byte_bpe_50k.json")).tokenizer, piece_units(vocabulary("piece_bpe_32k.model")).model
    return a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)


def test_words_give_the_ids_of_whole_texts(doc_rows):
    plain, led, pieces = byte_units(vocabulary("byte_bpe_50k.json")), byte_units(vocabulary("byte_bpe_50k.json"), " "), piece_units(vocabulary("piece_bpe_32k.model"))
    texts = STRANGE + [r[1] or "" for r in doc_rows]
    for units, want in ((plain, [plain.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]), (led, [whole(t)[0] for t in texts]), (pieces, [whole(t)[1] for t in texts])):
        for _ in range(2):  # the second time every word is known
            ids, counts, exact = units.batch(texts)
            assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
        assert [t for t, e in zip(texts, exact, strict=True) if not e] == (["a▁b"] if units is pieces else [])
    units = piece_units.__wrapped__(vocabulary("piece_bpe_32k.model"))
    units.most = 10
    assert all(units.batch([t])[0].tolist() == whole(t)[1] for t in texts[:40])


def test_words_cut_at_once_are_those_of_the_splitting_rule():
    rng = np.random.default_rng(4)
    signs = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "É", "1", "²", "!", "\xa0", "-", "’", "\x85", "\x1c", "_", "€"]
    odd = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 10, 5000)] + STRANGE + ["'", "'s", "x'", "s", "", "'r", "e"]
    latin = [t for t in odd if not unit_tokens._NOT_LATIN.search(t)]
    for some in (latin, [""], []):
        words, counts = unit_tokens.latin_words(some)
        want = [unit_tokens._LATIN_WORDS.findall(t) for t in some]
        assert [w.decode("utf-16-le") for w in words.to_pylist()] == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]
    units = byte_units(vocabulary("byte_bpe_50k.json"))
    for some in (odd, ["日本", "", "a 日本"], [""], []):
        assert all((a == b).all() for a, b in zip(units.bulk(some), units.batch(some)[:2], strict=True))


def brute_alignment(text):
    """Groups and links of one text, token by token."""
    if not text:
        return [], [], [], []
    a, b = whole(text)
    spell_a, spell_b = byte_units(vocabulary("byte_bpe_50k.json")).spelt, piece_units(vocabulary("piece_bpe_32k.model")).spelt
    want = (" " + text).encode()
    if b"".join(spell_a[x] for x in a) != want or b"".join(spell_b[x] for x in b) != want:
        return [], [], [], []

    def spans(ids, spell):
        at, out = 0, []
        for x in ids:
            out.append((at, at + len(spell[x])))
            at += len(spell[x])
        return out

    sa, sb = spans(a, spell_a), spans(b, spell_b)
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i][0] < sb[j][1] and sb[j][0] < sa[i][1]]
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, at = [], 0
    for cut in cuts:
        groups.append(([x for x, s in zip(a, sa, strict=True) if at <= s[0] < cut], [x for x, s in zip(b, sb, strict=True) if at <= s[0] < cut]))
        at = cut
    return a, b, groups, links


def brute_alignments(texts):
    found = [brute_alignment(t or "") for t in texts]
    count = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


@pytest.fixture(scope="module")
def strange(spark):
    rows = list(enumerate([*STRANGE, None, None, "the same", "the same"])) + [(None, "no id"), (None, "no id"), (3, "an id again")]
    return rows, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, `row` string, pairs int").repartition(3)


@pytest.mark.parametrize("most", [align.COMMON_PAIRS, 40])
def test_alignment_against_brute_force(spark, strange, most, monkeypatch):
    """Also where only few pairs are told to every task and the others are joined."""
    monkeypatch.setattr(align, "COMMON_PAIRS", most)
    rows, df = strange
    got = align.align_documents(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *x)) for (i, _), x in zip(rows, brute_alignments([t for _, t in rows]), strict=True))


def test_groups_and_pairs_in_writing(spark):
    text = "Shanre anin ndenon, überall"
    row = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    *_, groups, links = brute_alignment(text)
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert dict(zip(row.pairs, row.times, strict=True)) == Counter(a * align.B_IDS + b for a, b in links)


def test_alignment_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in op12_cross_tokenizer_alignment(spark, str(tmp_path)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_alignments([t for _, t in rows]), strict=True))


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for size, share in ((1, 1.0), (7, 0.5), (512, 0.9), (513, 0.01), (5000, 0.3), (4096, 0.0), (40_000, 1.0)):
        ones = rng.random(size) < share
        bits = fill_middle.BoundaryBits(ones)
        places, total = np.arange(size + 1), int(ones.sum())
        assert bits.rank(places).tolist() == np.concatenate([[0], np.cumsum(ones)]).tolist()
        assert bits.directory[-1] == total and bits.select(np.arange(total)).tolist() == np.flatnonzero(ones).tolist()


def brute_filled(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_against_brute_force(spark, strange, doc_rows, monkeypatch):
    monkeypatch.setattr(fill_middle, "SIDE_BY_SIDE", 3000)
    rows = strange[0] + [(1000 + r[0], r[1]) for r in doc_rows] + [(10**15 + k, t) for k, t in enumerate(STRANGE * 8)]
    filled = fill_middle.restore(fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in filled.collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *brute_filled(i, t), t or "")) for i, t in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_keeps_bytes_that_are_no_text(spark):
    raw = [b"plain \xff\xfe words", b"\x80\x80 begins in a character", b"ok"]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(raw * 20)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    rows = fill_middle.restore(fill_middle.fill_in_middle(df)).select("doc_id", "form", F.col("restored").cast("binary").alias("back")).collect()
    assert all(bytes(r.back) == raw[r.doc_id % 3] for r in rows) and len({r.form for r in rows}) > 1


def test_fill_in_middle_query(spark, empty):
    rows = {r.doc_id: r for r in op13_fill_in_middle(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n, form, prefix, middle, output = brute_filled(r.doc_id, r.text)
        g = rows[r.doc_id]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars) == (n, form, prefix, middle)
        assert g.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert fill_middle.restore(fill_middle.fill_in_middle(empty)).count() == 0 and align.align_documents(empty).count() == 0


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    cases = [rng.integers(0, 65536, (3, 700)), rng.integers(0, 3, (5, 1500)), np.zeros((1, 4096), int), np.full((2, 100), 65535), rng.zipf(1.3, (40, 900)) % 50257, rng.integers(0, 50257, (1, 1)), np.tile(np.arange(64), (4, 64))]
    for ids in cases:
        codes = id_coder.encode_blocks(ids)
        assert (id_coder.decode_blocks(codes, ids.shape[1]) == ids).all()
    # Repeats cost little, and noise costs no more than a little over its sixteen bits.
    assert sum(map(len, id_coder.encode_blocks(cases[2]))) < 100
    assert sum(map(len, id_coder.encode_blocks(cases[0]))) * 8 < 17.5 * cases[0].size


def test_any_block_is_read_without_the_others():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, (30, 800)) % 50257
    codes = id_coder.encode_blocks(ids)
    for k in (0, 7, 29):
        assert (id_coder.decode_blocks([codes[k]], 800)[0] == ids[k]).all()
        assert id_coder.encode_blocks(ids[k : k + 1]) == [codes[k]]


def test_carries_run_through_many_words():
    """Order 0 of one id and then another keeps the low end near the top of its range."""
    for pattern in ([0] * 3000 + [1], [5, 5, 5, 7] * 900, [1, 0] * 2000, list(range(3000))):
        ids = np.array([pattern])
        assert (id_coder.decode_blocks(id_coder.encode_blocks(ids), ids.shape[1]) == ids).all()


def test_the_encoder_finds_at_once_what_every_context_said_last():
    rng = np.random.default_rng(5)
    for ids in (rng.zipf(1.4, (70, 300)) % 50257, rng.integers(0, 3, (2, 500)), np.arange(40)[None], np.full((1, 9), 7)):
        for row, chunk in ((r, id_coder._Chunk(r[None].astype(np.uint16), 12)) for r in ids):
            twice = sorted(x for x in set(row.tolist()) if (row == x).sum() > 1)
            number = {x: k for k, x in enumerate(twice, 1)}
            numbers = np.array([number.get(x, 0) for x in row.tolist()], np.uint16)
            assert (chunk.numbers[0] == numbers).all() and chunk.known.tolist() == twice
            contexts = id_coder._slot(numbers, np.roll(numbers, 1))
            after, want = {}, []
            for c, now in zip(contexts.tolist(), numbers.tolist(), strict=True):
                says, sure = after.get(c, (0, 0))
                want.append(says * 4 + sure)
                after[c] = (now, min(sure + 1, 3) if says == now else 0)
            assert chunk.said(contexts[None])[0].tolist() == want


def test_ids_that_come_once_cost_their_sixteen_bits_and_little_more():
    assert len(id_coder.encode_blocks(np.arange(3000)[None])[0]) < 2.02 * 3000
    # Words that are taken two at a step, up to the longest block.
    rng = np.random.default_rng(6)
    for ids in (rng.zipf(1.2, (3, id_coder.MOST_IDS)) % 50257, np.concatenate([np.zeros(4000, int), np.repeat(np.arange(1, 49), 2)])[None]):
        assert (id_coder.decode_blocks(id_coder.encode_blocks(ids), ids.shape[1]) == ids).all()
    with pytest.raises(ValueError):
        id_coder.encode_blocks(np.zeros((1, id_coder.MOST_IDS + 1), int))


def written_file(docs):
    out = io.BytesIO()
    writer = id_files.FileWriter(out)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, np.uint16))
    assert writer.close() == len(out.getvalue())
    return out.getvalue()


def test_files_round_trip_and_show_damage(monkeypatch):
    monkeypatch.setattr(id_files, "LANES", 3)
    monkeypatch.setattr(id_files, "BLOCK_IDS", 500)
    rng = np.random.default_rng(3)
    docs = [(k if k else None, (rng.zipf(1.4, n) % 50257).tolist()) for k, n in enumerate([1, 4000, 0, 1500, 1, 1, 7000, 13])]
    data = written_file(docs)
    read = lambda b: [(i, s, np.concatenate([*p, []]).astype(int).tolist(), c) for i, s, p, c in id_files.FileReader(io.BytesIO(b), len(b)).documents()]
    starts = np.cumsum([0, *[len(x) for _, x in docs]]).tolist()
    assert read(data) == [(i, s, x, zlib.crc32(np.array(x, "<u4").tobytes())) for (i, x), s in zip(docs, starts, strict=False)]
    for at in (3, 60, len(data) // 2, len(data) - 60, len(data) - 2):
        with pytest.raises(id_files.Damaged):
            read(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :])
    assert read(written_file([])) == []


def brute_ids(rows):
    encode = byte_units(vocabulary("byte_bpe_50k.json")).tokenizer.encode
    ids = [(i, t or "", [*encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    return sorted(ids, key=lambda x: (x[0] is not None, x[0]))


def test_token_files_of_odd_rows(spark, strange, doc_rows, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(id_files, "FILE_IDS", 2000)
    rows = strange[0] + [(1000 + r[0], r[1]) for r in doc_rows]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, tie string").repartition(5)
    id_files.write_ids(df, f"{tmp_path}/ids")
    assert len(list(tmp_path.glob("ids/*.ids"))) > 3
    (tmp_path / "ids/part-00000-00000-left-by-a-lost-task.ids").write_bytes(b"half a file")
    got = sorted(id_files.read_ids(spark, f"{tmp_path}/ids", with_ids=True).collect(), key=lambda r: r.start)
    want = brute_ids(rows)
    assert [r.doc_id for r in got] == [i for i, _, _ in want] and sorted((repr(r.doc_id), r.ids) for r in got) == sorted((repr(i), x) for i, _, x in want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    id_files.write_ids(empty, f"{tmp_path}/none")
    assert id_files.read_ids(spark, f"{tmp_path}/none").count() == 0


def test_token_id_query(spark):
    want, start = {}, 0
    for i, _, ids in brute_ids([(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op11_token_id_output(spark, "/root/testdata/sf0.001").collect()} == want
