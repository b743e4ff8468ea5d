import random
import re

import pandas as pd
import pytest

from findgrain.llm import leakage

ITEMS = [
    (1, "Read, then answer. The clockmaker Thulglyn believed that 483 turns of the Phosdrak wheel would outlast every bell cast in Ostixi by hand."),
    (2, "What is 12 ms?"),
    (3, None),
    (4, ""),
    (5, "…!"),
    (6, "为什么草稿里少了六百个文件而且没有人知道"),
]


def found(spark, docs, items=ITEMS, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, hash string, item int")
    e = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, template string, doc int")
    return {(r["doc_id"], r["item_id"]): (r["windows"], r["verbatim"]) for r in leakage.find_leaks(d, e, **options).collect()}


def verbatim(spark, docs, items=ITEMS, **options):
    return {k for k, v in found(spark, docs, items, **options).items() if v[1]}


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = leakage.words_of(t or "")
        for i, x in items:
            v = leakage.words_of(x or "")
            k = min(leakage.WINDOW, len(v))
            if k and {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}:
                out.add((d, i))
    return out


def test_words():
    assert leakage.words_of("A-b_c 12.5 CAFÉ 索引かな ＡＢ") == ["a", "b", "c", "12", "5", "café", "索", "引", "か", "な", "ａｂ"]


@pytest.mark.parametrize("text", ["A-b_c 12.5 CAFÉ 索引かな ＡＢ", "x", "", "…", "İstanbul ΣΑΣ été \U00020000\U00020001a \U0001f642b が", "a\r\nb\tc_d", "12ms 3,4.5"])
def test_vectorised_words_are_those_of_the_pattern(text):
    w = leakage.Words(["zz", text, "yy"], [0, 1, 2])
    got = [w.low[a:b] for a, b, p in zip(w.start, w.end, w.piece) if p == 1]
    assert got == leakage.words_of(text)


def tokens(text):
    w = leakage.Words([text], [0])
    return leakage.Words.describe(w, "t", 0, len(w.token) - 1)[0] if len(w.token) else ""


def test_tokens():
    assert tokens("so Ann Lee paid 48.3 ms to Bob-Ray") == "t so @0 paid #1 %2 to @3"
    # only a unit after a number is one, and "to" is a word
    assert tokens("it's ms or 5 to 6, not 1,000 kb") == "t it s ms or #0 to #1 not #2 %3"
    # a capital at a sentence's start is a name where the text shows it
    assert tokens("Vexor came. He saw Vexor. He left.") == "t @0 came he saw @0 he left"
    assert tokens("Rose came. A rose saw Rose. Dr. Rose left.") == "t rose came a rose saw @0 dr @0 left"
    assert tokens("one\nAnn\r\nLee two\n\nBob") == "t one @0 two bob"


def test_verbatim_and_reparameterised(spark):
    copy = ITEMS[0][1].upper().replace(" ", "\n")
    other = "Note: the clockmaker Vexnyx believed that 77 turns of the Umbrjarl wheel would outlast every bell cast in Skolost by hand."
    decimal = "Note: the clockmaker Ann Lee believed that 48.3 turns of the Umbrjarl Drak wheel would outlast every bell cast in Skolost by hand."
    mixed = "the clockmaker Vexnyx believed that 77 turns of the Vexnyx wheel would outlast every bell cast in Vexnyx by hand."
    docs = [(1, copy), (2, other), (3, mixed), (4, None), (5, ""), (6, "so what is 12 MS? fine"), (7, copy), (8, "what is 13 ms"), (9, decimal), (None, copy)]
    got = found(spark, docs)
    assert {k for k, v in got.items() if v[1]} == {(1, 1), (7, 1), (6, 2)} == brute([d for d in docs if d[0]], ITEMS)
    # other names and numbers in place of the item's, of one word or several, whole or decimal: all windows of its twenty tokens
    assert got[2, 1] == got[9, 1] == (8, 0)
    assert got[8, 2] == (1, 0)
    # unless one value stands for several
    assert got.get((3, 1), (0, 0))[0] < got[2, 1][0]


def test_other_items_and_their_number_change_nothing(spark):
    other = "Note: the clockmaker Alice believed that 77 turns of the Umbrjarl wheel would outlast every bell cast in Skolost by hand."
    more = ITEMS + [(9, "an alice and a skolost of umbrjarl and thulglyn"), (10, "Phosdrak ostixi")]
    alone, among = found(spark, [(2, other)]), found(spark, [(2, other)], more)
    assert alone == among == {(2, 1): (8, 0)}
    assert found(spark, [(2, other)], more, broadcast_windows=0) == among


def test_random_texts_match_brute_force(spark):
    r = random.Random(4)
    vocabulary = "alpha beta Gamma 12 ms Kilo the of 索 引".split()
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([3, 13, 30]))) for i in range(12)]
    docs = [(i, text(20) + " " + (r.choice(items)[1] if r.random() < 0.5 else "") + " " + text(20)) for i in range(60)]
    for most in (leakage.BROADCAST_WINDOWS, 0):
        assert verbatim(spark, docs, items, broadcast_windows=most) == brute(docs, items)


def test_pieces_find_each_window_once(monkeypatch):
    made = pd.concat(leakage._item_windows([pd.DataFrame({"item": [i for i, t in ITEMS if t], "text": [t for _, t in ITEMS if t]})]))
    size = 1 << 20
    bits = leakage.np.zeros(size // 64, leakage.np.uint64)
    for h in made["hash"].to_numpy(leakage.np.int64).view(leakage.np.uint64):
        bits[int(h) % size // 64] |= leakage.np.uint64(1 << (int(h) % 64))
    finder = leakage.Finder(sorted(set(zip(made["family"], made["length"]))), bits)
    named = ITEMS[0][1].replace("Thulglyn", "Ann Lee").replace("483", "48.3")
    text = "So Ann came. What is 12 ms " * 7 + ITEMS[0][1] + " and more " + named + " what is 12 ms " + ITEMS[5][1] * 3 + " Ann"
    run = lambda: pd.concat(finder([pd.DataFrame({"doc": [1], "text": [text]})]))[["family", "template", "words"]].value_counts().to_dict()
    whole = run()
    assert sum(whole.values()) > 40
    for chars in (7, 90, 400):
        monkeypatch.setattr(leakage, "SLICE_CHARS", chars)
        assert run() == whole


def test_long_text_and_empty_tables(spark):
    long = "word " * 200_000 + ITEMS[0][1] + " word" * 1000
    assert set(found(spark, [(1, long), (2, "字" * 1_000_000)])) == {(1, 1)}
    assert found(spark, []) == {} and found(spark, [(1, "some text")], []) == {}
    assert found(spark, [(1, "some text")], [(3, None)]) == {}


def test_windows_of_few_literal_words_are_generalised(spark):
    short = "Was vergrub Wyndjarl unter der alten Brücke von Umbrnyx?"
    dense = "Read on, Thulglyn, Phosdrak, Ostixi, Vexnyx, Umbrjarl and Skolost paid 12, 13, 14 and 15"
    slots = "12 ms 13"
    items = [(1, short), (2, dense), (3, slots)]
    docs = [
        (1, "Was vergrub Gnarlfen unter der alten Mauer von Skolost?"),
        (2, "on, Alfa, Bravo, Carlo, Delta, Echo and Foxtrot paid 2, 3, 4 and 5"),
        (3, "on, Alfa, Alfa, Carlo, Delta, Echo and Foxtrot paid 2, 3, 4 and 5"),
        (4, "5 ms 6"),
        (5, "so 12 ms 13 it is"),
        (6, short),
        (7, dense),
    ]
    got = found(spark, docs, items)
    # nothing but slots is found by its words only, and one value cannot stand for two
    assert set(got) == {(1, 1), (2, 2), (5, 3), (6, 1), (7, 2)}
    assert {k for k, v in got.items() if v[1]} == {(5, 3), (6, 1), (7, 2)} == brute(docs, items)


TEMPLATES = [
    "In spring the surveyor {a} measured {n} rods of hedge between the mill at {b} and the chapel of {c} before noon.",
    "The ferryman {a} charged {n} pence for each cart that crossed to {b}, and gave the toll to the abbot of {c} every winter.",
    "When the quarry of {b} closed, the mason {a} sold {n} blocks of slate and moved his yard to a field near {c} for good.",
    "Der Küfer {a} schuldete der Mühle in {b} noch {n} Fässer Öl und zahlte sie erst im Herbst bei {c} zurück.",
    "Selon le registre, le tonnelier {a} devait {n} kg de sel au moulin de {b} et le rendit au prieur de {c} en hiver.",
]
FILLER = "the index keeps a copy of every file and the worker reads it again while Ann Lee waits for {n} ms near {a} so that nothing is lost".split()


def planted(seed, n):
    """Items of the templates, documents with re-parameterised copies of some, and which."""
    r = random.Random(seed)
    syllables = "vex nyx drak phos umbr jarl thul glyn keph".split()
    name = lambda: " ".join("".join(r.sample(syllables, 2)).title() for _ in range(r.choice([1, 1, 2])))
    number = lambda: r.choice([str(r.randint(2, 999)), f"{r.randint(2, 99)}.{r.randint(1, 9)}", f"{r.randint(1, 9)},{r.randint(100, 999)}"])
    fill = lambda t: re.sub(r"\{([abcn])\}", lambda m: number() if m[1] == "n" else name(), t)
    items = [(i, fill(t)) for i, t in enumerate(TEMPLATES)]
    docs, truth = [], set()
    for d in range(n):
        parts = [fill(" ".join(r.sample(FILLER, len(FILLER)))) for _ in range(3)]
        k = r.randrange(2 * len(TEMPLATES))
        if k < len(TEMPLATES):
            words = fill(TEMPLATES[k]).split()
            # whole, or most of it, with line breaks
            words = words if r.random() < 0.5 else words[r.randint(0, 2) : len(words) - r.randint(0, 2)]
            parts.insert(r.randint(0, 3), "".join(w + r.choice(["\n", " ", " ", " "]) for w in words))
            truth.add((d, k))
        elif k < len(TEMPLATES) + 2:
            # the words of a template in another order
            words = fill(TEMPLATES[k % len(TEMPLATES)]).split()
            r.shuffle(words)
            parts.insert(1, " ".join(words))
        docs.append((d, " ".join(parts)))
    return items, docs, truth


def test_planted_reparameterised_items(spark):
    items, docs, truth = planted(11, 300)
    got = set(found(spark, docs, items))
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got), (len(got), len(truth), len(got & truth))
    print("recall", len(got & truth) / len(truth), "precision", len(got & truth) / len(got))
