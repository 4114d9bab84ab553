"""Column expressions on hand-written rows."""

import os

from pyspark.sql import functions as F

from cardloom.functions import commands, names, text


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], ["i", *"abcd"[: len(rows[0]) if isinstance(rows[0], tuple) else 1]]).orderBy("i").select(column).collect()]


def test_stem_and_extension_are_those_of_the_file_system(spark):
    files = ["a.png", "a.b.png", ".png", "..png", "a_b", "a.b_c", "a.", "x..png", ""]
    assert values(spark, files, names.stem(F.col("a"))) == [os.path.splitext(f)[0] for f in files]
    assert values(spark, files, names.extension(F.col("a"))) == [os.path.splitext(f)[1] for f in files]


def test_parts(spark):
    stems = ["g_c", "g_c_s", "g_c_s_t", "g", "g_", "_c"]
    assert values(spark, stems, names.series(F.col("a"))) == ["g", "g", "g", "g", "g", ""]
    assert values(spark, stems, names.character(F.col("a"))) == ["c", "c", "c", "", "", "c"]
    assert values(spark, stems, names.suffix(F.col("a"))) == ["", "s", "s_t", "", "", ""]


def test_new_names(spark):
    assert values(spark, ["g_c", "g_c_s", "g", "g__c", "g_ c", "_c", "g_"], names.is_new_name(F.col("a"))) == [True, True, False, False, False, False, False]


def test_prefix_ends_at_a_boundary(spark):
    assert values(spark, ["g_c", "g_c_1", "g_cc", "g_cc_1"], names.starts_whole(F.col("a"), F.lit("g_c"))) == [True, True, False, False]
    assert values(spark, ["g_c", "g_cc", "x"], names.starts_plain(F.col("a"), F.lit("g_c"))) == [True, True, False]


def test_same_character(spark):
    assert values(spark, [("g_c", "g_c_1"), ("g_c", "g_d"), ("g", "g")], names.same_character(F.col("a"), F.col("b"))) == [True, False, False]


def test_renames_keep_suffix_and_extension(spark):
    rows = [("g_c.png", "g_d"), ("g_c_1.png", "g_d"), ("g_c_1.png", "g_d_1"), ("g_c.png", "g_d_2")]
    assert values(spark, rows, names.renamed(F.col("a"), F.col("b"))) == ["g_d.png", "g_d_1.png", "g_d_1.png", "g_d.png"]


def test_like_wildcard(spark):
    assert values(spark, ["ab", "abc", "abcd_x", "AB_x"], F.lower("a").like("ab_%")) == [False, True, True, True]


def test_numerals(spark):
    cases = {"一": 1, "十": 10, "十二": 12, "二十": 20, "二十三": 23, "一百": 100, "一百二十": 120, "二百三十四": 234, "一百五": 1005, "二二": 22, "": None, "abc": None}
    assert values(spark, list(cases), text.numeral(F.col("a"))) == list(cases.values())


def test_number_after_keyword(spark):
    assert values(spark, ["top12", "top二十", "top", "x"], text.number_after(F.col("a"), "top")) == [12, 20, None, None]


def test_elapsed(spark):
    assert values(spark, [0, 59, 60, 3600, 86399, 90061], text.elapsed(F.col("a"))) == ["0s", "59s", "1m", "1h", "23h59m59s", "1d1h1m1s"]


def test_between_and_target(spark):
    assert values(spark, ["x: a b \nc", "none"], text.between(F.col("a"), ":")) == ["a b", ""]
    assert values(spark, ["drawcards Foo ", "draw Foo cards", "draw"], text.optional_target(text.trimmed(F.col("a")), "draw", "cards")) == ["foo", "foo", ""]


def test_similarity(spark):
    # worked out by hand: twice the common subsequence by both lengths, in the window that a kept run aligns
    rows = [("abc", "abc"), ("abc", "xabcx"), ("abc", "abd"), ("", "abc"), ("abcdef", "abc"), ("abcd", "abxcd"), ("abc", None), ("ab", "xayb"), ("kitten", "sitting"), ("abcd", "dcba"), ("xyz", "abc")]
    got = values(spark, rows, text.similarity(F.col("a"), F.col("b")))
    # abcd/abxc 6/8; ab/yb or ab/xa 2/4; kitten/sittin 4 of 6 and 6: itt.n; abcd/dcba one letter
    assert got == [100, 110, 67, 10, 100, 75, None, 50, 67, 25, 0]


def test_blocks_are_those_of_a_least_edit_path():
    import random

    rng = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            before, row = row, [i]
            for j, d in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return row[-1]

    assert text.matching_blocks("abcd", "abxcd") == [(0, 0, 2), (2, 3, 2), (4, 5, 0)]
    assert text.matching_blocks("ab", "xayb") == [(0, 1, 1), (1, 3, 1), (2, 4, 0)]
    for _ in range(500):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 8))) for _ in range(2))
        blocks = text.matching_blocks(a, b)
        cost, i, j = 0, 0, 0
        for x, y, n in blocks:
            assert a[x : x + n] == b[y : y + n] and x >= i and y >= j
            cost += max(x - i, y - j)
            i, j = x + n, y + n
        assert cost == distance(a, b)
        lcs = len(a) + len(b)
        if a and b:
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for p, c in enumerate(a):
                for q, d in enumerate(b):
                    table[p + 1][q + 1] = table[p][q] + 1 if c == d else max(table[p][q + 1], table[p + 1][q])
            assert text.common_ratio(a, b) == 2 * table[-1][-1] / lcs


def test_commands(spark):
    rows = ["抽老婆", "抽原神老婆", "抽老公", "老婆改名 a", "老公概率十", "投票删除", "hello"]
    assert values(spark, rows, commands.command(F.col("a"))) == ["draw_a", "draw_a", "draw_b", "rename_a", "share_b", "vote", None]


def test_gates(spark):
    rows = [(False, True, False), (True, True, True), (True, False, True), (True, False, False)]
    assert values(spark, rows, commands.gate(F.col("a"), F.col("b"), F.col("c"))) == ["model_not_ready", "pass", "confirmation_pending", "ask_terms"]
