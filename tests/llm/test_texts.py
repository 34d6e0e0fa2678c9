"""Repeated strings and sentences, decontamination, mixing and token files against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

from boreline.llm import contamination, mixture, repeats, sentences, suffixes, tokenfiles


def distinct(rows):
    """Rows that agree in doc_id and text are one document; others of one doc_id go by a hash of the text."""
    found = {(i, t or "") for i, t, *_ in rows}
    return sorted(found, key=lambda r: (corpus.order(r[0]), zlib.crc32(r[1].encode()) & 0x7FFFFF))


def digest(data: bytes, gone: list[bool]) -> tuple:
    runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    return len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()


def repeated_strings(rows, length=100):
    seen, out = set(), {}
    for i, t in distinct(rows):
        data = t.encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            part = data[k : k + length]
            if part in seen:
                gone[k : k + length] = [True] * length
            seen.add(part)
        out[i, t] = digest(data, gone)
    return Counter((i, *out[i, t or ""]) for i, t, *_ in rows)


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_repeated_strings(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = Counter(map(tuple, repeats.digest(suffixes.remove_repeated_strings(docs)).collect()))
    assert got == repeated_strings(rows)


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_pieces_are_fetched_once(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(9)
    text = corpus.prose(rng, 8)
    words = text.split(" ")
    words[len(words) // 2] = "changed"
    near = " ".join(words)
    rows = [(1, text), (1, text), (2, near), *((k, text) for k in range(3, 40)), (1 << 40, text), (-1, near), (None, text), (None, text), (None, near)]
    whole = suffixes._repeated_starts

    def told(table):
        (tmp_path / f"{table.column('h')[0].as_py()}").write_text(str(table.num_rows))
        return whole(table)

    monkeypatch.setattr(suffixes, "_repeated_starts", told)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, repeats.digest(suffixes.remove_repeated_strings(docs)).collect()))
    assert got == repeated_strings(rows)
    # Two different texts, whatever the number of copies: so many pieces at most, fewer where they agree.
    most = sum(len(suffixes.anchors(*tokenfiles.text.flat(pa.array([t])))[0]) for t in (text, near))
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) <= most


def test_strings_that_repeat_within_a_text(spark):
    rng = random.Random(3)
    part = "".join(rng.choice("abc") for _ in range(160))
    rows = [(1, part + "-" + part), (2, "ab" * 400), (3, part[:99]), (4, part[20:130]), (5, "z" + part[:100])]
    got = Counter(map(tuple, repeats.digest(suffixes.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"))).collect()))
    assert got == repeated_strings(rows)


def test_columns_of_a_group():
    """The rounds give what comparing all strings gives, for pieces of other lengths, ties and several groups."""
    rng = np.random.default_rng(5)
    groups = np.sort(rng.integers(0, 6, 40))
    matrix = np.full((40, suffixes.COLUMNS), 0xFF, np.uint8)
    base = rng.integers(97, 100, suffixes.COLUMNS)
    for row in matrix:
        low = rng.integers(0, suffixes.SEEDS)
        high = rng.integers(low, suffixes.SEEDS) + suffixes.LENGTH
        row[low:high] = base[low:high]
        if rng.random() < 0.6:
            row[rng.integers(low, high)] = 120
    hit = suffixes.insert_columns(groups, matrix)
    for column in range(suffixes.SEEDS):
        seen = set()
        for k, group in enumerate(groups):
            part = matrix[k, column : column + suffixes.LENGTH]
            whole = not (part == 0xFF).any()
            assert hit[k, column] == (whole and (group, part.tobytes()) in seen)
            if whole:
                seen.add((group, part.tobytes()))


def cut(text):
    """Sentences as lists of words with the bytes they take."""
    data = text.encode()
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]
    hashes = [int(sentences.text.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for _, _, w in words]
    ends = [k + 1 == len(words) or re.search(rb"[.!?\n]", data[words[k][1] : words[k + 1][0]]) is not None for k in range(len(words))]
    picked = {j for k in range(len(words) - 9) for j in range(k, k + 10) if hashes[j] == min(hashes[k : k + 10])}
    pieces, begin = [], 0
    for k, end in enumerate(ends):
        if end:
            whole = list(range(begin, k + 1))
            stops = [j for j in whole if j == k or (len(whole) > 10 and j in picked)]
            for stop in stops:
                pieces.append([j for j in whole if j <= stop and (not pieces or j > pieces[-1][-1])])
            begin = k + 1
    edges = [0, *(words[p[0]][0] for p in pieces[1:]), len(data)]
    return [(tuple(words[j][2] for j in p), edges[n], edges[n + 1]) for n, p in enumerate(pieces)]


def repeated_sentences(rows):
    seen, out = set(), {}
    for i, t in distinct(rows):
        data, pieces, runs = t.encode(), cut(t), []
        for a in range(len(pieces)):
            for b in range(a + 3, len(pieces) + 1):
                if sum(len(w) for w, _, _ in pieces[a:b]) >= 12:
                    runs.append((a, b))
                    break
        if pieces and not runs:
            runs = [(0, len(pieces))]
        gone = [False] * len(data)
        for a, b in runs:
            key = tuple(w for p in pieces[a:b] for w in p[0])
            if key in seen:
                gone[pieces[a][1] : pieces[b - 1][2]] = [True] * (pieces[b - 1][2] - pieces[a][1])
            seen.add(key)
        out[i, t] = digest(data, gone)
    return Counter((i, *out[i, t or ""]) for i, t, *_ in rows)


def test_repeated_sentences(docs, rows):
    got = Counter(map(tuple, repeats.digest(sentences.remove_repeated_sentences(docs)).collect()))
    assert got == repeated_sentences(rows)


def test_any_long_passage_is_found(spark):
    """A passage of 51 words without any mark, between other words, in two texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for k in range(0, 80, 2):
        passage = [word() for _ in range(51)]
        rows += [(k + j, " ".join([*(word() for _ in range(rng.randint(0, 30))), *passage, *(word() for _ in range(rng.randint(0, 30)))])) for j in (0, 1)]
    found = sentences.remove_repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r["n_removed"] > 0) == (r["doc_id"] % 2 == 1) for r in found)


def test_empty_tables(empty):
    assert suffixes.remove_repeated_strings(empty).count() == 0
    assert sentences.remove_repeated_sentences(empty).count() == 0
    assert mixture.mix_sources(empty).count() == 0


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(corpus.LOWER))


def contaminated(rows, items, window=13):
    windows = defaultdict(set)
    for name, text in items:
        words = letter_words(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[k : k + size])].add("" if name is None else str(name))
    out = []
    for i, text, *_ in rows:
        words, met, hit = letter_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                found = windows.get(tuple(words[k : k + size]))
                if found:
                    met |= found
                    hit |= set(range(k, k + size))
        out.append((i, len(words), len(hit), tuple(sorted(met)), bool(hit) and 20 * len(hit) >= len(words)))
    return Counter(out)


@pytest.mark.parametrize("block", [contamination.BLOCK_WORDS, 25])
def test_contamination(spark, docs, rows, block):
    rng = random.Random(11)
    full = [t for _, t, *_ in rows if t and len(t) > 400]
    items = [(k, " ".join(rng.choice(full).split()[5:40])) for k in range(12)]
    items += [(20, "the THE the"), (20, "re"), (21, None), (22, ""), (None, full[1][:150]), (23, items[0][1]), (24, "... "), (25, corpus.prose(rng, 4)), (25, corpus.prose(rng, 4))]
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, words int")
    report = contamination.contamination_report(docs, table, block_words=block)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in report.collect())
    want = contaminated(rows, items)
    assert got == want
    clean = contamination.decontaminate(docs, table, block_words=block)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for (i, _, _, _, bad), n in want.items() for _ in range(n) if not bad)


@pytest.mark.parametrize("longest", [13, 20, 10**6])
def test_passages_are_cut_out(spark, longest):
    rng = random.Random(3)
    prose = [corpus.prose(rng, 700) + "." for _ in range(5)]
    passage = [f"q{k} é{k}" for k in range(20)]  # 40 words
    one, two = " -- ".join(passage), " ".join(passage[:7])
    loud = two.replace("q", "Q")
    texts = [
        f"{prose[0]}\n({one})\n{prose[1]}", f"{loud}!{prose[2]}", f"{prose[3]} {two}", f"{one} {two}", prose[4], None, "", "... ",
        f"{prose[0]} {one} {prose[1]} {two}? {prose[2]}",
    ] * 2
    docs = spark.createDataFrame([(i % 9, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, _cut string, _doc int")
    items = spark.createDataFrame([(1, " ".join(passage)), (2, None), (3, "")], "item_id long, text string")
    got = contamination.remove_passages(docs, items, longest=longest)
    assert got.columns == docs.columns
    # in the words of the passage, runs of 14 and 40
    def plain(t):
        t = t.replace(one, "") if t and longest < 40 else t
        return t.replace(two, "").replace(loud, "") if t and longest < 14 else t

    want = Counter((i % 9, plain(t), "x", i) for i, t in enumerate(texts) if i % 9 != 3)
    assert Counter(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert Counter(map(tuple, contamination.remove_passages(docs, none).collect())) == Counter(map(tuple, docs.collect()))
    assert contamination.remove_passages(docs.limit(0), items).count() == 0


def test_contamination_without_items(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.decontaminate(docs, none).count() == len(rows)
    assert contamination.contamination_report(empty, none).count() == 0


def water(sizes, weights, epochs=3):
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - epochs * sum(sizes[s] for s in capped)
        share = sum(w for s, w in weights.items() if s not in capped)
        new = {s for s in sizes if s not in capped and epochs * sizes[s] * share < rest * weights[s]}
        if not new:
            return {s: float(epochs * sizes[s]) if s in capped else rest * weights[s] / share for s in sizes}
        capped |= new


def test_mixture(docs, rows):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(corpus.spaced(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    mixed = mixture.mix_sources(docs)
    got = mixed.collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(corpus.spaced(t))) for i, t, *_ in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["times"] and 0 <= r["times"] <= 3
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in names)
    assert Counter(map(tuple, mixture.mix_sources(docs.repartition(7)).collect())) == Counter(map(tuple, got))
    out = mixture.repeat_documents(docs, mixed)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == sum((Counter({r["doc_id"]: r["times"]}) for r in got), Counter())


def test_targets_beyond_one_round(spark):
    sizes = {f"s{k:03d}": 10 ** (k % 5) * (k + 1) for k in range(40)}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sizes)}
    table = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight long")
    got = {r["source"]: r["target"] for r in mixture.water_fill(table).collect()}
    want = water(sizes, weights)
    assert all(abs(got[s] - want[s]) <= 1e-9 * want[s] for s in sizes)


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    found = Tokenizer.from_file(vocabulary)
    found.encode_special_tokens = True
    return found


def test_pieces_encode_to_the_ids_of_the_whole(vocabulary, tokenizer):
    rng = random.Random(1)
    letters = list("ab'st  \n\t.,!9 0é×÷ñ中　 €😀ßd<|endoftext|>\u0085\x1c-_ll're've")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)] + [None, ""]
    ids, counts = tokenfiles.Encoder(vocabulary)(pa.array(texts))
    stops = np.concatenate([[0], np.cumsum(counts)])
    for k, found in enumerate(tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert found.ids == ids[stops[k] : stops[k + 1]].tolist()


def _with_marks(marks, count=4000):
    rng = random.Random(2)
    parts = [*marks, *(m[:k] for m in marks for k in (1, 2, len(m) - 1)), *(m[k:] for m in marks for k in (1, len(m) // 2)), " ", "  ", "\n", "a", "B", "9", "'s", "é", "中", "!"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(count)] + [None, "", "a <|endoftext|> b"]


def test_added_tokens_in_texts_are_one_id(vocabulary):
    plain = Tokenizer.from_file(vocabulary)
    texts = _with_marks(["<|endoftext|>"])
    ids, counts = tokenfiles.Encoder(vocabulary)(pa.array(texts))
    stops = np.concatenate([[0], np.cumsum(counts)])
    for k, found in enumerate(plain.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert found.ids == ids[stops[k] : stops[k + 1]].tolist()
    assert ids[stops[-2] :].tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}, {"normalized": True}])
def test_added_tokens_of_any_kind(vocabulary, tmp_path, flags):
    plain = Tokenizer.from_file(vocabulary)
    plain.add_special_tokens([AddedToken("<|a|>", normalized=False), AddedToken("<|a|><|a|>b", normalized=False)])
    plain.add_tokens([AddedToken("aBa", **{"normalized": False, **flags})])
    plain.save(str(tmp_path / "v.json"))
    texts = _with_marks(["<|a|>", "<|a|><|a|>b", "aBa"], 1500)
    ids, counts = tokenfiles.Encoder(str(tmp_path / "v.json"))(pa.array(texts))
    stops = np.concatenate([[0], np.cumsum(counts)])
    for k, found in enumerate(plain.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert found.ids == ids[stops[k] : stops[k + 1]].tolist()


def test_token_files_of_texts_with_marks(spark, vocabulary):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "plain")]
    plain = Tokenizer.from_file(vocabulary)
    want, at = [], 0
    for i, t in rows:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfiles.token_files(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 7, 1000, 10**12], list(range(0, 5000, 3)), [2**40] * 300])
def test_elias_fano(values):
    coded = tokenfiles.EliasFano.encode(np.array(values, np.uint64))
    again, end = tokenfiles.EliasFano.unpack(memoryview(coded.pack()), 0)
    assert end == len(coded.pack())
    assert again.all().tolist() == values and [again[i] for i in range(len(values))] == values
    assert len(coded.pack()) <= 48 + (2.2 + np.log2(max(2, (values[-1] if values else 0) / max(1, len(values)) + 1))) * len(values) / 8 + 8 * (len(values) // 256 + 2)


def test_token_files(spark, docs, rows, tokenizer, vocabulary, tmp_path, empty):
    manifest = tokenfiles.write_shards(docs, f"file://{tmp_path}/shards", vocabulary, shard_ids=2000)
    found = sorted(tokenfiles.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert manifest.count() > 3
    at, stream = 0, []
    for r in found:
        assert r["start"] == at
        at += len(r["ids"])
        stream.append((r["doc_id"], tuple(r["ids"])))
    encoded = [(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, *_ in rows]
    assert Counter(stream) == Counter(encoded)
    assert [i for i, _ in stream] == sorted((i for i, _ in encoded), key=corpus.order)
    digests = tokenfiles.token_files(spark, docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in digests) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in encoded)
    assert tokenfiles.token_files(spark, empty).count() == 0
