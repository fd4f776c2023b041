import numpy as np
import pyarrow as pa

from brinelink.llm import templates
from brinelink.llm import textarrays as ta
from brinelink.llm.common import table
from brinelink.llm.templates import canonical, contaminated

QUESTION = "Yesterday the farmer Alvarez sold 12 crates of pears weighing 30 kg and kept 12 crates for his neighbour Bertrand"


def kinds(text):
    data = np.frombuffer(text.encode(), np.uint8)
    _, kind, starts, ends, _ = canonical(data, np.array([0, len(data)]))
    return [(int(k), data[a:b].tobytes().decode()) for k, a, b in zip(kind, starts, ends)]


def test_canonical_tokens():
    got = kinds('The cat, "Élodie" ran 5km in 1,200.5 seconds -- SHOUTING. Then (Bob) paid $30 x7.\nNew line')
    assert [k for k, _ in got] == [0, 0, 4, 0, 2, 0, 1, 3, 0, 0, 4, 0, 1, 0, 0, 0]
    assert got[1][1] == "cat" and got[6][1] == "1,200.5"
    assert kinds("") == [] and kinds(" .,; ") == []


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def test_reparameterised_questions(spark, docs_of):
    other = QUESTION.replace("12", "47").replace("30", "95").replace("Alvarez", "Castillo").replace("Bertrand", "Delacroix")
    clash = QUESTION.replace("sold 12", "sold 47").replace("kept 12", "kept 51")
    rows = [
        (1, "Some words before. " + QUESTION + " and after"),
        (2, "noise " * 5000 + other),
        (3, clash),
        (4, "A farmer sold some pears and kept crates"),
        (5, None),
        (6, ""),
        (6, "..."),
        (7, "short item"),
        (8, QUESTION),
        (8, QUESTION),
        (None, other),
        (9, "Yesterday the farmer Alvarez sold 12 crates of pears"),
    ]
    items = [(1, QUESTION), (1, QUESTION), (2, "short item"), (3, None), (4, ""), (5, "Not in any document at all, surely")]
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(rows), bench(spark, items)).collect()}
    assert got == {(1, 1), (2, 1), (7, 2), (8, 1), (None, 1)}
    several = contaminated(docs_of(rows), bench(spark, items), per_pass=7)
    assert {(r.doc_id, r.item_id) for r in several.collect()} == got
    assert contaminated(docs_of(rows).where("false"), bench(spark, items)).count() == 0
    assert contaminated(docs_of(rows), bench(spark, items).where("false")).count() == 0


def test_one_clashing_value_in_a_long_copy(spark, docs_of):
    """Only windows that hold the odd reading are lost; without a majority, all that hold the value."""
    words = [f"word{i}" for i in range(120)]
    for i in (10, 40, 70):
        words[i] = "12"
    typo, even = list(words), list(words)
    typo[40] = "12.0"
    even[40], even[70] = "12.0", "13"
    rows = [(1, " ".join(words)), (2, " ".join(typo)), (3, "before " * 30 + " ".join(even))]
    got = {r.doc_id: (r.covered, r.windows) for r in contaminated(docs_of(rows), bench(spark, [(1, " ".join(words))])).collect()}
    assert got == {1: (116, 116), 2: (111, 116), 3: (101, 116)}


def test_whole_table(spark, sf):
    """All that hold an item word for word, and nothing that does not hold half of its windows."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, items).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    held = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if r.text and r.text in t}
    assert held <= set(got)

    def windows(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return set(templates.template_windows(data, np.array([0, len(data)]))[0].tolist()) if len(data) else set()

    for r in items.collect():
        mine = windows(r.text or "")
        for d, t in texts.items():
            if (d, r.item_id) in got:
                assert len(mine & windows(t)) >= 0.5 * len(mine)


def wide_kinds(text):
    data = np.frombuffer(text.encode(), np.uint8)
    _, kind, starts, ends, _ = canonical(data, np.array([0, len(data)]), wide=True)
    return [(int(k), data[a:b].tobytes().decode()) for k, a, b in zip(kind, starts, ends)]


def test_wide_reading():
    got = wide_kinds("Tom has 3 pears. How many does Mary Ann give to Tom, Bob and Иван Петров?\nИван left")
    assert [t for k, t in got if k == 4] == ["Tom", "Mary Ann", "Tom", "Bob", "Иван Петров", "Иван"]
    assert [k for k, t in wide_kinds("Иван left. Then he saw Иван") if t == "Иван"] == [4, 4]
    assert wide_kinds("") == [] and wide_kinds("Tom. Tom")[0][0] == 0


STORIES = [
    "{a} has {n} {thing}. {a} buys {m} more at the market near the {place}. How many {thing} does {a} have now?",
    "Every morning {a} carries {n} {thing} to the {place}. On the way back {b} takes {m} of them. How many {thing} does {a} keep for {b}?",
    "{a} and {b} share {n} {thing} in the {place}. If {a} eats {m} of the {thing}, how many are left for {b} and for {a}?",
    "{a} купила {n} яблок в магазине возле дома. Потом {a} отдала соседке {m} яблок. Сколько яблок теперь есть у {a} для пирога в {place}?",
]
NAMES = ["Tom", "Sara", "Mary Ann", "José", "Zoë", "Иван", "Мария", "Анна Мария", "Ελένη", "Łukasz"]


def test_recall_of_items_asked_again(spark, docs_of):
    """200 questions with other names (one or two words, four scripts) and numbers, and as many of the same shape about other things."""
    rng = np.random.default_rng(5)
    things = [f"{x}{y}s" for x in ("ap", "pe", "lem", "plu", "mel") for y in ("ple", "ar", "on", "m", "berry", "nut", "cone", "seed", "leaf", "root")]
    places = [f"{x}{y}" for x in ("sta", "har", "gar", "for", "bri") for y in ("tion", "bour", "den", "est", "dge", "mill", "farm", "hall", "gate", "yard")]
    items, again, other = [], [], []
    for i in range(200):
        story, thing, place = STORIES[i // 50], things[i % 50], places[i % 50]

        def told(thing, place):
            a, b = rng.choice(NAMES, 2, replace=False)
            n, m = rng.choice(np.arange(2, 900), 2, replace=False)
            return story.format(a=a, b=b, n=n, m=m, thing=thing, place=place)

        items.append((i, told(thing, place)))
        again.append((i, "Some words stand here before it. " + told(thing, place) + " And some come after."))
        other.append((1000 + i, " ".join(f"{w}{i}" if len(w) > 3 and w.islower() else w for w in told(thing, place).split())))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(again + other), bench(spark, items)).collect()}
    assert sum((i, i) in got for i, _ in items) >= 180
    assert not [d for d, _ in got if d >= 1000]


def test_both_readings_start_from_the_same_tokens():
    """Words and hashes are made once for the two readings, which leave them as they are."""
    texts = ["Anna Maria Bell paid $30 for 12 km. Anna went on to New York with 5kg of rice", "", "one", "so Ökonom Östen\nÖsten said 3 miles"]
    data, at = ta.utf8(pa.array(texts))
    shared = templates.tokens_of(data, at)
    for wide in (False, True, False):
        alone, both = (templates.template_windows(data, at, wide=wide, tokens=t) for t in (None, shared))
        for a, b in zip([*alone[:-1], *alone[-1]], [*both[:-1], *both[-1]], strict=True):
            assert np.array_equal(a, b)
