"""The parts of the operators that need no Spark, against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cardloom.llm import circulant_dedup, code_store, consistent_parsing, content_region, jump_sharding, merge_rounds, robust_quality, slack_packing
from cardloom.llm.token_ids import Encoder
from cardloom.llm.words import Words, flat, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = list(" \n\t\r\x0b\x0c\x00\x1c\x1f\x85\xa0é中 　ab'stre1٣!<|>_😀é‍﻿▁") + ["<|endoftext|>", "  ", "\xa0 ", " \xa0", "'s", "é  ", "<s>", "the the", "aaaa", " ing"]


def random_texts(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)] + [None, "", " ", "\n", "a"]


def test_words_equal_the_pattern():
    texts = random_texts(500, 1)
    w = Words(*flat(pa.array(texts)))
    distinct = [x.decode() for x in w.distinct.to_pylist()]
    for i, t in enumerate(texts):
        assert [distinct[k] for k in w.code[w.first[i] : w.first[i + 1]]] == WORD.findall(t or "")


def test_slices_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 100, 1, 0, 3)]})
    parts = list(slices(batch, "text", 10))
    assert sum(p.num_rows for p in parts) == 6 and pa.Table.from_batches(parts)["text"].to_pylist() == batch["text"].to_pylist()
    assert list(slices(batch.slice(0, 0), "text")) == []


def test_jump_moves_only_into_the_new_shard():
    keys = np.array([*range(20000), -1, -(2**63), 2**63 - 1])
    for n in (1, 2, 8, 31):
        a, b = jump_sharding.jump(keys, n), jump_sharding.jump(keys, n + 1)
        assert a.min() >= 0 and a.max() < n
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02


def test_jump_equals_the_published_loop():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [0, 1, 2, 12345, 2**40 + 7, 2**63 - 1]
    assert jump_sharding.jump(np.array(keys), 1000).tolist() == [plain(k, 1000) for k in keys]


def test_packing_plan_places_each_length_once_within_capacity():
    rng = random.Random(5)
    for capacity in (8, 64, 1024):
        counts = Counter(rng.randint(1, capacity - 1) for _ in range(500))
        used, windows, padding = Counter(), 0, 0
        for pattern, repeats in slack_packing.plan(dict(counts), capacity):
            fill = sum(k * m for k, m in pattern)
            assert 0 < fill <= capacity
            padding += repeats * slack_packing.slack(fill, capacity)
            windows += repeats
            for k, m in pattern:
                used[k] += m * repeats
        assert used == counts
        assert padding < 0.05 * windows * capacity
    assert slack_packing.plan({}, 10) == []


def test_closest_is_the_best_multiset():
    from itertools import product

    rng = random.Random(3)
    for _ in range(100):
        counts = {k: rng.randint(1, 3) for k in rng.sample(range(1, 24), 4)}
        anchor = max(counts)
        found = slack_packing.closest(dict(counts), anchor, 32)
        left = dict(counts) | {anchor: counts[anchor] - 1}
        fills = [anchor + sum(k * m for k, m in zip(left, ms)) for ms in product(*[range(n + 1) for n in left.values()])]
        best = min(slack_packing.slack(f, 32) for f in fills if f <= 32)
        fill = sum(k * m for k, m in found)
        assert all(m <= counts[k] for k, m in found) and fill <= 32
        assert slack_packing.slack(fill, 32) == best


def test_byte_bpe_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = random_texts(4000, 2)
    ids, at = Encoder(path).encode(pa.array(texts))
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_piece_bpe_equals_the_library_both_ways():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = random_texts(4000, 3) + ["a" * 3000, "ab" * 2000, "".join(rng.choice("etaoinshr") for _ in range(5000)), " " * 300, "中" * 100, "\udcff".encode("utf-8", "replace").decode()]
    m = merge_rounds.Merger(path)
    ids, at = m.encode(pa.array(texts, pa.string()))
    decoded = m.decode(ids, at)
    for i, want in enumerate(library.encode([t or "" for t in texts], add_bos=True, add_eos=True)):
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert decoded[i].decode() == library.decode(want)


@pytest.mark.parametrize("kind", ["spaces", "letters", "base64", "one letter"])
def test_a_million_unbroken_characters_equal_the_library_in_seconds(kind):
    import base64
    import time

    import sentencepiece

    path, rng, n = public_tokenizers.path("piece_bpe_32k.model"), random.Random(11), 1_000_000
    text = {"spaces": " " * n, "letters": "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)), "base64": base64.b64encode(rng.randbytes(n * 3 // 4)).decode(), "one letter": "e" * n}[kind]
    m, library = merge_rounds.Merger(path), sentencepiece.SentencePieceProcessor(model_file=path)
    began = time.time()
    ids, at = m.encode(pa.array([text]))
    decoded = m.decode(ids, at)[0].decode()
    assert time.time() - began < 30
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == want and decoded == library.decode(want)


def test_heap_and_rounds_merge_alike(monkeypatch):
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(12)
    texts = pa.array(random_texts(500, 12, 200) + ["".join(rng.choices("ab  thei中=", k=rng.randint(1, 400))) for _ in range(300)], pa.string())
    rounds = merge_rounds.Merger(path).encode(texts)
    monkeypatch.setattr(merge_rounds, "ROUND_SYMBOLS", 1)
    heap = merge_rounds.Merger(path).encode(texts)
    assert rounds[0].tolist() == heap[0].tolist() and rounds[1].tolist() == heap[1].tolist()


@pytest.mark.parametrize("module, setting", [("token_ids", "CACHE_BYTES"), ("merge_rounds", "CACHE_BYTES")])
def test_what_a_worker_holds_is_bounded_by_bytes(monkeypatch, module, setting):
    import importlib

    monkeypatch.setattr(importlib.import_module(f"cardloom.llm.{module}"), setting, 5000)
    rng = random.Random(13)
    made = Encoder(public_tokenizers.path("byte_bpe_50k.json")) if module == "token_ids" else merge_rounds.Merger(public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(20):
        made.encode(pa.array(["".join(rng.choices("abcdefgh", k=3000))]))
        assert sum(map(len, made.known)) == made.held_bytes <= 5000


def test_workers_that_forget_give_the_same_ids(monkeypatch):
    from cardloom.llm import token_ids

    monkeypatch.setattr(token_ids, "CACHE_PIECES", 5)
    monkeypatch.setattr(merge_rounds, "CACHE_WORDS", 5)
    texts = pa.array(["a b c d e f g", "h i j k l m", "a b z"])
    e, m = Encoder(public_tokenizers.path("byte_bpe_50k.json")), merge_rounds.Merger(public_tokenizers.path("piece_bpe_32k.model"))
    whole = e.encode(texts)[0].tolist(), m.encode(texts)[0].tolist()
    pieces = [e.encode(texts.slice(i, 1))[0].tolist() for i in range(3)], [m.encode(texts.slice(i, 1))[0].tolist() for i in range(3)]
    assert whole[0] == sum(pieces[0], []) and whole[1] == sum(pieces[1], [])


@pytest.mark.parametrize("most", [1, 200, 256, 70000, 2**31])
def test_codes_give_any_id_and_any_run(most):
    rng = np.random.default_rng(most)
    ids = rng.integers(0, most, 5000)
    keys, starts = np.array([1, 2]), np.array([0, 1000, 5000])
    k, s, codes = code_store.from_bytes(code_store.to_bytes(keys, starts, ids))
    assert k.tolist() == [1, 2] and s.tolist() == starts.tolist() and len(codes) == 5000
    for i in [0, 1, 511, 512, 513, 4999, *rng.integers(0, 5000, 50).tolist()]:
        assert codes[i] == ids[i]
    for a, b in [(0, 5000), (0, 0), (5000, 5000), (7, 8), (511, 1025), *np.sort(rng.integers(0, 5000, (30, 2)), axis=1).tolist()]:
        assert codes.run(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        codes[5000]


class Counted(__import__("io").BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        data = super().read(n)
        self.bytes_read += len(data)
        return data


def test_a_token_is_read_from_a_file_without_reading_the_rest():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, 2_000_000)
    data = code_store.to_bytes(np.array([1, 2]), np.array([0, 1000, len(ids)]), ids)
    file = Counted(data)
    keys, starts, codes = code_store.opened(file)
    before = file.bytes_read
    for i in [0, len(ids) - 1, *rng.integers(0, len(ids), 200).tolist()]:
        assert codes[i] == ids[i]
    assert (file.bytes_read - before) / 202 < 500 and file.bytes_read < len(data) / 20
    assert codes.run(999_990, 1_000_100).tolist() == ids[999_990:1_000_100].tolist() and codes.run(5, 5).tolist() == []
    assert keys[:].tolist() == [1, 2] and starts[1] == 1000
    for broken in (data[:-1], data[:100], b"", b"x" * 100):
        with pytest.raises(ValueError):
            code_store.opened(Counted(broken))


def test_empty_and_damaged_token_files():
    data = code_store.to_bytes(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    assert len(code_store.from_bytes(data)[2]) == 0
    with pytest.raises(ValueError):
        code_store.from_bytes(data[:-1] + b"x")


def names_of(text):
    return consistent_parsing.least_names(*flat(pa.array([text], pa.string())))[0]


def test_equal_substrings_share_interior_phrases_at_any_offset():
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    one, level = [], consistent_parsing.LEVEL
    for before in ("", "x", "some words before it ", "0123456789" * 7):
        data, offsets = flat(pa.array([before + shared]))
        symbols, starts = data, offsets[:1]
        for _ in range(level):
            symbols, starts = consistent_parsing.parse_level(symbols, starts)
        one.append(symbols.tolist())
    base = Counter(one[0])
    for other in one[1:]:
        assert sum((base & Counter(other)).values()) > 0.9 * len(one[0])


def test_fingerprints_of_texts_do_not_depend_on_their_batch():
    texts = random_texts(200, 6, 400)
    together = consistent_parsing.least_names(*flat(pa.array(texts)))
    for t, names in zip(texts, together):
        assert names.tolist() == names_of(t).tolist()


M64 = 2**64 - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_toss(labels):
    """Each label by the lowest bit in which it differs from its left neighbour, and that bit."""
    out = [labels[0] & 1]
    for left, right in zip(labels, labels[1:]):
        bit = 0
        while left != right and (left >> bit & 1) == (right >> bit & 1):
            bit += 1
        out.append(2 * bit + (right >> bit & 1))
    return out


def plain_phrases(symbols, is_bytes):
    """One level: runs folded, coins tossed, phrases begun at local maxima, named."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    labels = [s for s, _ in runs]
    for _ in range(3 if is_bytes else 4):
        labels = plain_toss(labels)
    n = len(runs)
    begins = [i == 0 or (0 < i < n - 1 and labels[i] > labels[i - 1] and labels[i] >= labels[i + 1]) for i in range(n)]
    names, phrase = [], []
    for i, (s, times) in enumerate(runs):
        if begins[i] and phrase:
            names.append(phrase)
            phrase = []
        name = plain_mix(s + 0x9E3779B97F4A7C15 & M64) if is_bytes else s
        phrase.append(plain_mix(name + times * 0xD6E8FEB86659FD93 & M64) if times > 1 else name)
    names.append(phrase)
    return [plain_mix(sum(x * (plain_mix(k % 128 + 1) | 1) for k, x in enumerate(p)) & M64) for p in names]


def plain_fingerprint(text):
    symbols = list(text.encode())
    if not symbols:
        return []
    for level in range(3):
        symbols = plain_phrases(symbols, level == 0)
    return sorted({plain_mix(s ^ 0x5851F42D4C957F2D) >> 32 for s in symbols})[:64]


def test_fingerprints_equal_a_plain_parse():
    rng = random.Random(61)
    texts = random_texts(150, 60, 300) + ["".join(rng.choice(["ab", "the ", "x" * 9, "\n", "é", "中"]) for _ in range(rng.randint(1, 3000))) for _ in range(20)] + ["a" * 5000, "ab" * 3000]
    got = consistent_parsing.least_names(*flat(pa.array(texts, pa.string())))
    for t, names in zip(texts, got):
        assert names.tolist() == plain_fingerprint(t or "")
    for a, b in zip(got, got[1:]):
        union = sorted({*a.tolist(), *b.tolist()})[:64]
        both = {*a.tolist()} & {*b.tolist()}
        want = float(not len(a) and not len(b)) if not len(a) or not len(b) else sum(x in both for x in union) / len(union)
        assert consistent_parsing.likeness(a, b) == pytest.approx(want)
    assert consistent_parsing.text_of(got[-1]) == "".join(f"{x:08x}" for x in plain_fingerprint(texts[-1]))


def test_sampled_likeness_is_near_the_whole_one():
    """The sketch keeps 64 names: its estimate scatters by about sqrt(j (1 - j) / 64) around the share of all names."""
    rng = random.Random(62)
    off = []
    for _ in range(60):
        base = "".join(rng.choices("abcdefghijklmnop ", k=20_000))
        cut = rng.randint(0, 20_000)
        other = base[:cut] + "".join(rng.choices("abcdefghijklmnop ", k=20_000 - cut))
        whole = consistent_parsing.least_names(*flat(pa.array([base, other])), keep=10**9)
        j = len(np.intersect1d(*whole)) / len(np.union1d(*whole))
        off.append(consistent_parsing.likeness(whole[0][:64], whole[1][:64]) - j)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.0625


def test_likeness_is_the_jaccard_of_small_sets():
    a, b = np.array([1, 3, 5, 7], np.uint64), np.array([3, 5, 9], np.uint64)
    assert consistent_parsing.likeness(a, b) == 2 / 5 and consistent_parsing.likeness(a, a) == 1
    assert consistent_parsing.likeness(a[:0], b) == 0 and consistent_parsing.likeness(a[:0], b[:0]) == 1


def test_shingle_sets_and_signatures():
    texts = ["A b c d e f g a b c d e f g a b c d e", "a B C D E f g", "a b", "A B", "", None, "  ", "x"]
    sets = circulant_dedup.shingle_sets(pa.array(texts))
    words = [WORD.findall((t or "").lower()) for t in texts]
    want = [len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1) for w in words]
    assert [len(s) for s in sets] == want
    assert sets[2].tolist() == sets[3].tolist() and len(np.intersect1d(sets[0], sets[1])) == 3
    assert (circulant_dedup.signature(sets[2]) == circulant_dedup.signature(sets[3])).all()
    # agreement of coordinates estimates the similarity
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    other = np.concatenate((base[:800], rng.integers(0, 2**63, 100).astype(np.uint64)))
    agree = (circulant_dedup.signature(base) == circulant_dedup.signature(other)).mean()
    assert abs(agree - 0.8) < 0.15


def plain_statistics(text):
    text = text or ""
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_statistics_equal_a_plain_count():
    rng = random.Random(8)
    texts = random_texts(300, 8) + [" ".join(rng.choice(["a", "b", "c\n", "\n", "#x", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = robust_quality.text_statistics(pa.array(texts))
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[k][i]) for k in keys) for i in range(len(texts))] == [plain_statistics(t) for t in texts]


def test_word_statistics_equal_a_plain_count():
    texts = random_texts(300, 18, 200) + ["Über Ähre “quoted” 3.5 x-y-z.. " + "a" * 50 + " http://x.y/?a=1&b=2"]
    got = robust_quality.text_statistics(pa.array(texts))

    def is_mark(c):
        return (c < "\x80" and not c.isalpha()) or "\x80" <= c <= "\xbf" or "\u2000" <= c <= "\u2bff" or "\u3000" <= c <= "\u303f"

    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        capitals = sum("A" <= w[0] <= "Z" or "\xc0" <= w[0] <= "\xde" for w in words)
        want = len(set(words)), capitals, sum(min(2, sum(map(is_mark, w))) for w in words), sum(min(20, len(w)) for w in words)
        assert tuple(int(got[k][i]) for k in ("n_distinct", "n_capitals", "n_marks", "n_short_chars")) == want


def test_consistency_factors():
    assert robust_quality.chi_square_share(robust_quality.chi_square(5, 0.5), 5) == pytest.approx(0.5, abs=0.003)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200_000, 5))
    d = (x**2).sum(1)
    for share in (0.5, 0.975):
        assert (x[d <= np.quantile(d, share)] ** 2).mean() * robust_quality.consistency(5, share) == pytest.approx(1, abs=0.01)


def test_chi_square_quantiles():
    assert robust_quality.chi_square(6, 0.5) == pytest.approx(5.348, abs=0.02)
    assert robust_quality.chi_square(4, 0.975) == pytest.approx(11.143, abs=0.05)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Home page</a></li></ul></nav><!-- c --><div class="ad">Buy this now</div>
<article><h1>A title here</h1><p>One <b>two</b> three &amp; four&nbsp;five six<br>seven eight nine.<script>var t="</p>";</script><p>Ten eleven   twelve thirteen.</p>%s<p>Last words of it all.</p></article>
<footer>All rights reserved</footer></body></html>"""


def test_main_text():
    weight = content_region.weights([(f, a, b) for f, a, b in [("w:p", 900, 0), ("w:h1", 50, 0), ("w:div", 0, 90), ("w:footer", 0, 90), ("t:p", 90, 0), ("t:div", 0, 90), ("t:footer", 0, 9)]])
    want = "A title here One two three & four five six seven eight nine. Ten eleven twelve thirteen. Last words of it all."
    assert content_region.main_text(content_region.tokens(PAGE % ""), weight) == want
    inner = "<aside>Side words</aside><form>Your name<input></form><section class='comments'><p>I think so</p></section>"
    assert content_region.main_text(content_region.tokens(PAGE % inner), weight) == want
    assert content_region.main_text(content_region.tokens((PAGE % "").replace("article", "div")), weight) == want
    assert content_region.main_text(content_region.tokens(""), weight) == ""
    assert content_region.main_text(content_region.tokens("<nav>a b c</nav>"), weight) == ""
    assert content_region.main_text(content_region.tokens("<p>cut off wor<b"), weight) == "cut off wor"
    assert content_region.main_text(content_region.tokens("<p>a < b <!-- open"), weight) == "a < b"


def learnt_weights():
    """Weights as pages like ``PAGE`` teach them."""
    within, outside = Counter(), Counter()
    for i in range(40):
        page = PAGE % f"<p>Here is sentence {i} of it. And then another one, which is longer than the first.</p>"
        a, b = content_region.count_features(content_region.tokens(page.replace("Buy this now", "Buy this now, it is cheap. You will like it a lot.")))
        within.update(a)
        outside.update(b)
    return content_region.weights([(f, within[f], outside[f]) for f in {*within, *outside}])


PROSE = "Prices rose again this week. Analysts who had expected a fall were surprised by the strong demand from abroad."


@pytest.mark.parametrize("mark", ['class="share-price"', 'id="menu-planning"', 'class="post related-work"', 'class="notice-period"', 'id="related-history" class="essay"', 'class="promotion-history"', 'class="headerless"', 'class="search-engines"', 'class="lead"', 'role="main"'])
@pytest.mark.parametrize("marked", ["article", "div"])
def test_article_text_stays_whatever_words_its_names_hold(mark, marked):
    page = (PAGE % f"<div {mark}><p>{PROSE}</p></div>").replace("article", marked)
    assert PROSE in content_region.main_text(content_region.tokens(page), learnt_weights())


@pytest.mark.parametrize("inner", [
    f'<section class="comments"><p>{PROSE}</p></section>', f'<div id="comment-list"><p>{PROSE}</p></div>', f'<ol class="userComments"><li>{PROSE}</ol>', f'<div class="ad">{PROSE}</div>',
    f'<div class="cookie-notice">{PROSE}</div>', '<ul class="menu"><li><a href="/">Home page</a><li><a href="/x">Other page</a></ul>', '<div class="share-buttons"><a href="/">Share it</a> <a href="/">Send it</a></div>',
    f'<aside>{PROSE}</aside>', f'<div role="complementary">{PROSE}</div>', f'<form>{PROSE}<input></form>', '<div class="related"><a href="/">Other page one</a><a href="/">Other page two</a></div>',
])
def test_what_is_no_part_of_an_article_goes(inner):
    want = "A title here One two three & four five six seven eight nine. Ten eleven twelve thirteen. Last words of it all."
    weight = learnt_weights()
    assert content_region.main_text(content_region.tokens(PAGE % inner), weight) == want
    assert content_region.main_text(content_region.tokens((PAGE % inner).replace("article", "div")), weight) == want


def test_long_and_deep_pages_take_time_in_proportion():
    import time

    weight = learnt_weights()
    pages = ["<div>" * 20_000 + "</span>" * 20_000 + f"<p>{PROSE}</p>", PAGE % (f"<p>{PROSE}</p>" * 10_000), "<b>" * 50_000 + PROSE + "</i>" * 50_000, '<div class="' * 5_000 + PROSE]
    for page in pages:
        began = time.time()
        text = content_region.main_text(content_region.tokens(page), weight)
        assert time.time() - began < 10
    assert content_region.main_text(content_region.tokens(pages[1]), weight).count(PROSE) == 10_000


def test_crc_of_runs_is_that_of_ids():
    ids = np.array([1, 300, 70000])
    codes = code_store.CodeArray.of(ids)
    assert zlib.crc32(codes.run(0, 3).astype("<u4")) == zlib.crc32(ids.astype("<u4"))
