"""E1 BILOU decoding and J7 mention resolution (golden rows)."""
from storyloom.operators.entities import decode_bilou, link_mentions, resolve_mentions


def decode(spark, tags, ignore=()):
    rows = [(1, i, w, t) for i, (w, t) in enumerate(tags)]
    df = spark.createDataFrame(rows, "text_id int, tok_id int, word string, tag string")
    return sorted(r["entity"] for r in decode_bilou(df, ["text_id"], ignore).collect())


def test_bilou_cases(spark):
    assert decode(spark, [("Paris", "U-LOC")]) == ["Paris"]
    assert decode(spark, [("New", "B-LOC"), ("York", "L-LOC")]) == ["New York"]
    assert decode(spark, [("a", "B-X"), ("b", "I-X"), ("c", "I-X"), ("d", "L-X")]) == ["a b c d"]
    assert decode(spark, [("a", "B-X"), ("b", "O")]) == []
    assert decode(spark, [("a", "B-X"), ("b", "B-X"), ("c", "L-X")]) == ["b c"]
    assert decode(spark, [("a", "L-X"), ("b", "U-X")]) == ["b"]
    assert decode(spark, [("a", "B-X"), ("o", "O"), ("c", "L-X")]) == ["a c"]
    assert decode(spark, [("a", "B-X"), ("b", "L-X"), ("c", "L-X")]) == ["a b", "a b c"]
    assert decode(spark, [("a", "B-X"), ("u", "U-Y"), ("c", "L-X")]) == ["a c", "u"]
    assert decode(spark, [("5", "U-CARDINAL"), ("x", "U-ORG")], ["CARDINAL"]) == ["x"]


def test_resolve_mentions(spark):
    texts = spark.createDataFrame(
        [(1, "He met her. She smiled."), (2, "No mentions."), (3, "He and him"),
         (4, "end He")], "doc int, t string")
    ments = spark.createDataFrame(
        [(1, 0, 2, "John"), (1, 12, 15, "Mary"), (3, 0, 10, "Both"), (3, 7, 10, "x"),
         (4, 4, 6, "Bob")], "doc int, start int, end int, replacement string")
    got = {r["doc"]: r["o"] for r in resolve_mentions(texts, ments, ["doc"], "t", "o").collect()}
    assert got == {1: "John met her. Mary smiled.", 2: "No mentions.", 3: "Both",
                   4: "end Bob"}


def test_shorter_names_stand_for_longer_ones(spark):
    texts = spark.createDataFrame(
        [(1, "Smith came. Dr Anna Smith spoke; Smith and Anna Smith left. Later, Bob Smith met Smith."),
         (2, "Smith alone."), (3, None), (4, ""), (5, "Anna Smith, smith, Smithson."), (6, "Él vio a José Ñandú. Ñandú rió.")],
        "doc int, t string")
    links = link_mentions(texts, ["doc"], "t")
    got = {r["doc"]: r["o"] for r in resolve_mentions(texts, links, ["doc"], "t", "o").collect()}
    # the first name has nothing before it; of two longer names more words win
    assert got == {
        1: "Smith came. Dr Anna Smith spoke; Dr Anna Smith and Dr Anna Smith left. Later, Bob Smith met Dr Anna Smith.",
        2: "Smith alone.", 3: None, 4: "", 5: "Anna Smith, smith, Smithson.", 6: "Él vio a José Ñandú. José Ñandú rió."}


def test_links_follow_the_definition(spark):
    """Against a scan of every text, with runs longer than a name."""
    import random
    import re
    rnd = random.Random(3)
    words = ["Anna", "Bob", "Cy", "Dee", "and", "saw"]
    texts = [(d, " ".join(rnd.choice(words) for _ in range(60)) + rnd.choice(["", ".", "\nAnna"])) for d in range(30)]
    got = {(r["doc"], r["start"]): (r["end"], r["replacement"]) for r in link_mentions(
        spark.createDataFrame(texts, "doc int, t string"), ["doc"], "t").collect()}
    want = {}
    for d, t in texts:
        seen = []
        for m in re.finditer(r"[A-Z][a-z]+(?: [A-Z][a-z]+){0,5}", t):
            longer = [(len(x.split()), i, x) for i, x in enumerate(seen) if x.endswith(" " + m.group())]
            if longer:
                want[d, m.start()] = (m.end(), max(longer)[2])
            seen.append(m.group())
    assert got == want and len(want) > 30


def test_lexicon_decides_keywords(spark):
    """a user's part of speech and lemma count before the suffix rules."""
    from storyloom.operators.tokens import keyword_valid
    words = spark.createDataFrame([("running",), ("stone",), ("walks",)], "word string")
    stop = spark.createDataFrame([("the",)], "word string")
    lexicon = spark.createDataFrame([("running", "running", "NOUN"), ("stone", "stone", "VERB"), ("walks", "the", "NOUN")],
                                    "word string, lemma string, pos string")
    keep = lambda **x: sorted(r["word"] for r in keyword_valid(words, "word", stop, **x).collect())
    assert keep() == ["stone", "walks"] and keep(lexicon=lexicon) == ["running"]
