"""Items whose windows leave gaps, short items, and items written anew with other names and numbers."""

import random

from reelsift.llm import decontaminate

FILLER = "nothing here is like it at all and so the text goes on for a while"
DENSE = "A shop sells 12 pens at 3 dollars, 15 books at 20 dollars and 7 bags at 30 dollars. How much is it in total"


def pairs(spark, docs, items):
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id, r.reparameterised) for r in got}


def test_number_dense_and_short_items_are_found(spark):
    gap = "we know that all of these are given in 1 2 3 4 5 6 7 8 9 10 11 12 and now add them to the rest please"
    items = [(1, DENSE), (2, "3 + 4 equals what"), (3, "17 19 23"), (4, gap)]
    docs = [
        (1, f"{FILLER}. {DENSE}. {FILLER}"), (2, f"{FILLER}. {DENSE.replace('12', '14').replace('30', '50')}"), (3, DENSE.replace("books", "cups").replace("pens", "nuts").replace("bags", "hats")),
        (4, f"{FILLER}: 8 + 9 equals what? {FILLER}"), (5, f"{FILLER} 17 19 23"), (6, f"{FILLER} 17 19 24"), (7, f"{FILLER} {gap}"), (8, FILLER), (9, gap.replace(" 5 6 ", " x y ").replace("know", "see").replace("rest", "sum")),
    ]
    assert pairs(spark, docs, items) == {(1, 1, False), (2, 1, True), (4, 2, True), (5, 3, False), (7, 4, False)}


def test_items_written_anew_are_found(spark):
    r = random.Random(6)
    names = ["Anna", "Ben", "Élodie", "Жанна", "Carla Maria", "Tom", "Ángel Luis Ortiz"]
    numbers = ["1,500", "3.5", "900", "7", "12", "1'000'000"]
    item = "{a} has {x} apples and buys {y}{g}kg of pears from a man in the market. {b} gives {x} of them away to {a}. How many are left now?"
    items, docs, want = [(0, item.format(a="Anna", b="Ben", x="12", y="5", g=""))], [], set()
    for i in range(40):
        a, b = r.sample(names, 2)
        x, y = r.sample(numbers, 2)
        text = item.format(a=a, b=b, x=x, y=y, g=r.choice(["", " "]))
        docs.append((i, r.choice(["", FILLER + " ", FILLER + ". ", "as Anna said "]) + text + r.choice(["", " " + FILLER])))
        want.add(i)
    lines = items[0][1]
    docs += [(50, f"{FILLER} {lines}"), (51, lines.lower()), (52, lines.upper()), (53, FILLER)]
    got = pairs(spark, docs, items)
    assert {d for d, _, _ in got if d < 50} == want
    assert {x for x in got if x[0] >= 50} == {(50, 0, False), (51, 0, False), (52, 0, False)}
    short = "Anna buys 3 pens and Ben sells 4 cups"
    assert pairs(spark, [(0, f"{FILLER} Élodie Roux buys 3,5 pens and Tom sells 900 cups {FILLER}"), (1, f"{FILLER} Élodie buys 3 pens and Tom sells many cups")], [(0, short)]) == {(0, 0, True)}
