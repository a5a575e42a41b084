"""Edited, resized, partly quoted and re-set copies of benchmark items."""

from ontoloom.llm import decontaminate

DATA = "/root/testdata/sf0.001"
AROUND = "Some opening words of a page that nobody knows. {} And then a closing line follows here."


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, AROUND.format(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, items).collect()}


def test_one_edited_word(spark):
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()]
    edited = []
    for t in items:
        words = t.split(" ")
        at = len(words) // 2
        edited += [" ".join([*words[:at], "zzinserted", *words[at:]]), " ".join([*words[:at], "zzchanged", *words[at + 1 :]]), " ".join([*words[:at], *words[at + 1 :]])]
    got = found(spark, edited, items)
    assert set(got) == {(i, i // 3) for i in range(len(edited))}


def test_resized_slots_short_items_and_quotes(spark):
    items = [
        "A farmer sells his apples to Tom for 5 coins and keeps the other 12 in a basket by the door.",
        "how many legs does an old brown spider usually have",
        " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)),
    ]
    texts = [items[0].replace("Tom", "Mary Ann").replace("5", "5 km").replace("12", "twelve"), items[1].replace("brown", "black"), " ".join(items[2].split()[40:80]), " ".join(items[2].split()[40:55])]
    assert set(found(spark, texts, items)) == {(0, 0), (1, 1), (2, 2)}


def test_verbatim_copies_poor_in_words(spark):
    items = ["What is 12 + 35 * 7?", "3 14 15 92 65 35 89 79 32 38 46 26", "the Great, Northern Express Railway Company, Limited Of Upper Canada, Ontario Division"]
    assert set(found(spark, items, items)) == {(i, i) for i in range(3)}
    assert found(spark, ["What is 11 + 34 * 6?", "4 15 16 93 66 36 90 80 33 39 47 27"], items) == {}


def test_numbers_may_become_equal(spark):
    item = "A farmer has 3 apples and 5 pears in a basket and then gives every one of them away. How many are left?"
    same = item.replace("3", "4").replace("5", "4")
    twice = "Every day 3 boys and 3 girls walk over the old bridge to the school behind the wood."
    assert found(spark, [same, twice.replace("3 boys", "4 boys").replace("3 girls", "6 girls"), twice.replace("3", "4")], [item, twice]) == {(0, 0): True, (2, 1): True}


def test_slots_outside_the_quote_have_no_veto(spark):
    item = "A farmer has 3 apples and 5 pears in a basket by the door and then gives every one of them away to people who pass by with 3 dogs"
    quote = item.replace("3 apples", "4 apples").rpartition(" people")[0]
    assert found(spark, [f"{quote} men of the town with 9 dogs"], [item]) == {(0, 0): True}


def test_case_and_wrapping(spark):
    item = "the town where Anna met Bert, who knew Carl and Dora, from Essen or Fulda, with Gina and Hans, all of them old, went to Italy"
    lines = item.replace(" Anna", "\nAnna").replace(" Carl", "  Carl").replace(" Essen", "\u00a0Essen").replace(" Gina", "\r\n\tGina")
    other = {"Anna": "Ida", "Bert": "Jan", "Carl": "Kai", "Dora": "Lea", "Essen": "Mainz", "Fulda": "Neuss", "Gina": "Olga", "Hans": "Paul", "Italy": "Spain"}
    renamed = item
    for n, (a, b) in enumerate(other.items()):
        renamed = renamed.replace(f" {a}", ("\n", "  ", "\u00a0", "\r\n\t")[n % 4] + b)
    assert found(spark, [item.lower(), item.upper(), lines, renamed], [item]) == {(0, 0): False, (1, 0): False, (2, 0): False, (3, 0): True}


def test_no_items(spark):
    assert found(spark, ["any text"], [None]) == {}
