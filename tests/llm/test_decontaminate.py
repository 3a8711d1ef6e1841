import random

from lorekeep.llm import decontaminate as D

ITEM = "A train leaves Paris at 8 and covers 120 km before lunch, then Anna rides 40 miles home with Anna and 8 friends in the old car."
OTHER = "the quick brown fox jumps over the lazy dog near the river bank every single morning"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    kept = sorted((str(r.doc_id), r.text or "") for r in D.keep_clean(d, b).collect())
    return sorted((str(r.doc_id), r.item_id) for r in D.leaks(d, b).collect()), kept


def test_templates(spark):
    rows = [("It took Anna 1,234.5 km, and Bob 3 days. Then he 3D",)]
    df = spark.createDataFrame(rows, "text string")
    r = df.select(D._template(df.text).alias("t"), D._words(D._joined_numbers(df.text)).alias("w")).first()
    assert r.t == "it took nameslot numslot unitslot and nameslot numslot unitslot then he 3d".split() and len(r.t) == len(r.w) and r.w[3] == "12345"


def test_leaks(spark):
    same = "Intro words here. " + ITEM + " And an end."
    changed = "x " + ITEM.replace("8", "9").replace("120", "300").replace("40", "77").replace("Anna", "Berta").replace("Paris", "Rome").replace("km", "m")
    torn = ITEM.replace("at 8", "at 9").replace("and 8", "and 7").replace("120", "9")  # 8 is 9 and 7; 9 is 8 and 120
    docs = [(1, same), (2, changed), (3, torn), (4, None), (5, ""), (6, "no such thing " * 4000), (7, OTHER.upper() + "!"), (8, "quick brown fox jumps over"), (9, "the quick brown fox jumps over the lazy dog"), (None, same), (1, same), (10, "8 9 10 11 12 13 14 15 16 17 18"), (11, "tiny item"), (12, "z " * 50_000 + OTHER)]
    got, kept = run(spark, docs, [(100, ITEM), (101, OTHER), (102, None), (103, ""), (104, "1 2 3 4 5 6 7 8 9 10"), (105, "tiny item"), (101, OTHER)])
    assert got == sorted([("1", 100), ("2", 100), ("None", 100), ("7", 101), ("12", 101), ("11", 105)])
    assert [k for k, _ in kept] == sorted(["3", "4", "5", "6", "8", "9", "10"])


def test_empty(spark):
    assert run(spark, [(1, ITEM)], []) == ([], [("1", ITEM)])
    assert run(spark, [], [(1, ITEM)]) == ([], [])


def test_plain_windows_as_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("ab cd ef gh ij kl".split())
    items = [(i, " ".join(word() for _ in range(14))) for i in range(6)]
    docs = []
    for i in range(150):
        w = [word() for _ in range(r.randint(0, 30))]
        src = r.choice(items)[1].split()
        a, b = sorted((r.randint(0, 14), r.randint(0, 14)))
        docs.append((i, " ".join(w[:7] + src[a:b] + w[7:])))

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    want = sorted((str(d), i) for d, t in docs for i, b in items if sum(tuple(b.split()[k : k + 8]) in grams(t) for k in range(7)) >= 3)
    assert run(spark, docs, items)[0] == want and want


def test_each_occurrence_is_checked_alone(spark):
    variant = ITEM.replace("8", "9").replace("120", "300").replace("40", "77").replace("Anna", "Berta").replace("km", "m")
    third = variant.replace("300", "500")
    twice = "we know that the price of one apple here is 5 euros today and yet again we know that the price of one apple here is 6 euros today or so"
    chance = ITEM + " Later on, " + "a bus stops at 5 and covers 9 km before lunch, then Olga leaves. " + "Well " * 30 + "rides 7 miles home with Paul and 3 friends in the old car."
    split = lambda t, word: t.replace("lunch", f"{word} lunch").replace("home", f"{word} home")
    docs = [(1, ITEM + " Or else. " + variant), (2, variant + " Or else. " + third), (3, "So " + twice), (4, chance), (5, split(ITEM, "late") + " Or else. " + split(variant, "big"))]
    got, _ = run(spark, docs, [(100, ITEM), (101, twice)])
    assert got == [("1", 100), ("2", 100), ("3", 101), ("4", 100), ("5", 100)]


def test_lower_case_and_items_without_id(spark):
    changed = ITEM.replace("8", "9").replace("120", "300").replace("40", "77").replace("Anna", "Berta").replace("Paris", "Rome")
    got, _ = run(spark, [(1, ITEM.lower()), (2, "So: " + ITEM.upper()), (3, changed), (4, changed.lower())], [(None, ITEM)])
    assert got == [("1", None), ("2", None), ("3", None)]  # other names can't be told from other words in lower case


def test_windows_of_few_literal_words_match_exactly(spark):
    table = "12 45 78 Rome 9 km and 31 44 7 euros 18 52"
    mixed = "9 8 7 6 5 4 3 2 the wheel of fortune turned on"
    items = [(100, "What is 12 times 3 plus 4"), (101, "Capital of France"), (102, table), (103, mixed)]
    docs = [(1, "Say, what is 12 times 3 plus 4?"), (2, "What is 12 times 5 plus 4"), (3, "the capital of France."), (4, "the capital of Spain."), (5, "Row " + table + " end"), (6, table.replace("78", "79").replace("31", "32"))]
    docs += [(7, mixed), (8, mixed.replace("4", "40").replace("3", "30").replace("2", "20"))]
    got, kept = run(spark, docs, items)
    assert got == [("1", 100), ("3", 101), ("5", 102), ("7", 103), ("8", 103)]
    assert [k for k, _ in kept] == ["2", "4", "6"]
