import math
import random

import pytest

from ledgerloom.llm import mixing, pii, pii_labels


def make_docs(spark, n=400):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["tilt", "gap", "lens", "probe"]) for _ in range(rng.randrange(1, 60))) + f" {k}", ["a", "b", "c", None, "zzz"][k % 5]) for k in range(n)]
    rows += [(n + k, rows[k][1], "a") for k in range(40)] + [(n + 100, None, "a"), (n + 101, "", "b")]
    return rows, spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, source string, n_tokens int")


def test_mixture(spark):
    rows, docs = make_docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets)
    used = m.mixed().collect()
    text = {i: t for i, t, _ in rows}
    uses = {}
    for r in used:
        uses[text[r.doc_id]] = uses.get(text[r.doc_id], 0) + 1
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(r.repeat <= caps[r.source] for r in used)
    assert max(uses.values()) <= 3 and all(text[r.doc_id] for r in used)
    shares = {r.source: r for r in m.shares().collect()}
    assert shares.keys() == {"a", "b", "c"}
    assert sum(r.share for r in shares.values()) == pytest.approx(1)
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert shares[s].share == pytest.approx(want, abs=0.04)
    assert [tuple(r) for r in used] == [tuple(r) for r in mixing.Mixture(docs, targets).mixed().collect()]  # the same each time
    assert all(0 < r < math.inf for r in m.rates.values())  # counts of the tightest source are drawn too
    assert len({r.repeat for r in used if r.source == "b"}) > 1 and shares["b"].texts_used < shares["b"].texts_held
    # copies of a text are one text
    assert len({text[r.doc_id] for r in used}) == len({r.doc_id for r in used})
    over = mixing.Mixture(docs, targets, total_tokens=10**9)
    assert all(r.tokens_used == r.tokens_held * r.max_repeats for r in over.shares().collect())


def test_mixture_empty(spark):
    _, docs = make_docs(spark, 50)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.Mixture(docs.limit(0), targets).mixed().count() == 0
    assert [r.share for r in mixing.Mixture(docs.limit(0), targets).shares().collect()] == [0.0]
    assert mixing.Mixture(docs, targets.limit(0)).mixed().count() == 0
    with pytest.raises(ValueError):
        mixing.Mixture(docs, targets, max_sources=0)


def test_poisson_steps_and_rate():
    steps = mixing.poisson_steps(1.3, 4)
    assert steps[2] == pytest.approx(sum(math.exp(-1.3) * 1.3**k / math.factorial(k) for k in range(3)))
    bins = {b: 5 for b in range(mixing.BINS)}
    for wanted in (0.1, 0.9, 1.7):
        rate = mixing.solve_rate(bins, 3, wanted * 5 * mixing.BINS)
        mean = sum(1 - s for s in mixing.poisson_steps(rate, 3))
        assert mean == pytest.approx(wanted, rel=0.01)
    assert mixing.solve_rate(bins, 2, 1e12) == math.inf and mixing.solve_rate({}, 2, 5) == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers(name):
    count = mixing.token_counter(f"{mixing.TOKENIZERS}/{name}")
    texts = ["", "a tilt  stage", "<|endoftext|> is text", "x" * 20_000, "Zoé\n\n  σ"]
    got = count(texts)
    assert len(got) == 5 and got[0] == 0 and got[1] > 1 and got[3] > 100
    if name.startswith("byte"):
        assert got[:3] + got[4:] == [n for k, n in enumerate(mixing.token_counter(f"{mixing.TOKENIZERS}/byte_bpe_50k.json")(texts)) if k != 3]


GIVEN, FAMILY = frozenset({"elif", "zoé", "tobin", "maren"}), frozenset({"kellor", "dorvquist", "mardari", "brendune", "quenick"})


def sentences(n, seed):
    rng = random.Random(seed)
    fill = ["The tilt stage drifted by 3.2 um.", "We booked 40 hours on the comb.", "The Kellor-Mardari relation predicts 7 V. Our fit agrees.", "Lot 0478-91-423 failed.", "Package numtools@3.4 was pinned.", "See run 2021-03-5926 for the trace."]
    out = []
    for _ in range(n):
        g, f = rng.choice(["Elif", "Zoé", "Tobin", "Maren"]), rng.choice(["Kellor", "Dorvquist", "van Mardari", "Brendune"])
        name = rng.choice([f"{g} {f}", f"{g[0]}. {f}", f"{g} {f}".upper(), f"{f}, {g}"])
        mail = rng.choice([f"{g.lower()}@kiln.test".replace("é", "e"), f"{f.split()[-1].lower()} at kiln dot test"])
        made = [(f"Contact: ", name, "name"), (f"write to ", mail, "email"), ("call ", rng.choice(["+44 20 7946 0632", "(783) 555-0173", "030/23125-018"]), "phone"), ("passport no. ", f"X{rng.randrange(10**6, 10**7)}", "id_number"), ("shipped to ", rng.choice(["12 Alder Lane, Flat 3, Norwick", "8 rue des Tanneurs, 55761 Groenveld", "Lindenweg 10, 45126 Norwick"]), "address")]
        spans, text = [], ""
        for lead, surface, kind in rng.sample(made, rng.randrange(0, 4)):
            text += rng.choice(fill) + " " + lead
            spans.append((len(text), len(text) + len(surface), pii.TYPES.index(kind)))
            text += surface + rng.choice([" today. ", ", as said. ", "\n"])
        out.append((text + rng.choice(fill), sorted(spans)))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.fit([t for t, _ in sentences(500, 1)], GIVEN, FAMILY)


def test_held_out_accuracy(field):
    held = sentences(200, 2)
    words = pii.Words([t for t, _ in held], GIVEN, FAMILY)
    got = {m for m in pii.mentions(words, field.decode(words))}
    want = {(i, *s) for i, (_, spans) in enumerate(held) for s in spans}
    right = len(got & want)
    assert right / len(got) > 0.95 and right / len(want) > 0.95
    assert not any("relation" in held[i][0][b : b + 10] for i, _, b, kind in got if kind == 0)


def test_messages_agree_with_enumeration():
    """On a chain without links the best path is the best of all; with a link of strength 0 nothing changes."""
    words = pii.Words(["Call Elif now"], GIVEN, FAMILY)
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    f = pii.Field(rng.normal(size=(pii.BUCKETS, pii.N_LABELS)).astype(np.float32), rng.normal(size=(pii.N_LABELS, pii.N_LABELS)), np.zeros((pii.N_SORTS, pii.N_TOGETHER)), GIVEN, FAMILY)
    score = f.scores(words)

    def value(path):
        if not pii._START[path[0]]:
            return -1e9
        v = score[0, path[0]]
        for a, b in itertools.pairwise(path):
            if not pii._ALLOWED[a, b]:
                return -1e9
        return v + sum(f.moves[a, b] + score[k + 1, b] for k, (a, b) in enumerate(itertools.pairwise(path)))

    best = max(itertools.product(range(pii.N_LABELS), repeat=3), key=value)
    assert tuple(f.decode(words)) == best
    marg = f.beliefs(np.exp(score.astype(float)), words.rows)
    every = [(p, math.exp(value(p))) for p in itertools.product(range(pii.N_LABELS), repeat=3) if value(p) > -1e8]
    whole = sum(w for _, w in every)
    for label in range(pii.N_LABELS):
        assert marg[1, label] == pytest.approx(sum(w for p, w in every if p[1] == label) / whole, abs=1e-6)


def test_skip_links_join_repeats_once():
    words = pii.Words(["Kellor met Tobin Kellor. KELLOR left; kellor@kiln.test of T. Kellor, ext. 55501, or 55501", "Kellor"], GIVEN, FAMILY)
    got = {(words.tokens[x], words.tokens[y], int(s)) for x, y, s in zip(*words.skip_links(), strict=True)}
    assert got == {("Kellor", "Kellor", 0), ("Kellor", "KELLOR", 0), ("KELLOR", "Kellor", 0), ("KELLOR", "kellor", 1), ("kellor", "Kellor", 1), ("Tobin", "T", 2), ("55501", "55501", 3)}
    assert len(words.skip_links()[0]) == 7 and not len(pii.Words([""], GIVEN, FAMILY).skip_links()[0])


def test_the_field_finds_what_no_pattern_matches(field):
    """Given and family names that no list holds, streets and numbers of other shapes: the patterns that label the sample find few of them, the field nearly all."""
    rng = random.Random(5)
    fill = ["The tilt stage drifted by 3.2 um.", "We booked 40 hours on the comb.", "The Kellor-Mardari relation predicts 7 V. Our fit agrees.", "Lot 0478-91-423 failed.", "See run 2021-03-5926 for the trace."]
    held = []
    for _ in range(120):
        text, spans = "", []
        for lead, kind, make in rng.sample([("Contact: ", 0, lambda: f"{rng.choice(['Quilla', 'Ombra', 'Wystan', 'Ferro'])} {rng.choice(['Ulmquist', 'Thraven', 'Ostrander', 'Pelloway'])}"), ("write to ", 1, lambda: f"{rng.choice('qwz')}{rng.randrange(99)}x@{rng.choice(['north', 'mill'])}.test"), ("call ", 2, lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"), ("passport no. ", 3, lambda: f"K{rng.randrange(10**6, 10**7)}"), ("shipped to ", 4, lambda: f"{rng.randrange(1, 99)} {rng.choice(['Osier', 'Heron'])} Lane, Flat {rng.randrange(1, 9)}, Norwick")], 2):
            text += rng.choice(fill) + " " + lead
            surface = make()
            spans.append((len(text), len(text) + len(surface), kind))
            text += surface + rng.choice([" today. ", ", as said. ", "\n"])
        held.append((text + rng.choice(fill), spans))
    want = {(i, *s) for i, (_, spans) in enumerate(held) for s in spans}
    words = pii.Words([t for t, _ in held], GIVEN, FAMILY)
    got = set(pii.mentions(words, field.decode(words)))
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9
    by_patterns = {(i, *s) for i, (t, _) in enumerate(held) for s in pii_labels.sample_labels(t, GIVEN, FAMILY)}
    names = {w for w in want if w[3] == 0}
    assert not names & by_patterns and len(names & got) / len(names) >= 0.9


def test_links_carry_a_label_to_an_unclear_place():
    """A name is told by its first place only; without links the later place is labelled like that of the apparatus beside it."""
    rng = random.Random(8)

    def word():
        return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))).capitalize()

    def made(n):
        out = []
        for _ in range(n):
            a, b, c, d = word() + "x", word() + "q", word() + "x", word() + "q"
            pair, thing = f"{a} {b}", f"{c} {d}"
            first = rng.random() < 0.5
            later = [pair, thing] if first else [thing, pair]
            text = f"Visitor {pair} came in. The apparatus {thing} was on. It was warm. Then {later[0]} stayed, and then {later[1]} stayed."
            at = text.index(pair)
            again = text.index(pair, at + 1)
            out.append((text, [(at, at + len(pair), 0), (again, again + len(pair), 0)]))
        return out

    train, held = made(500), made(100)
    f = pii.fit([t for t, _ in train], frozenset(), frozenset(), spans=[s for _, s in train])
    words = pii.Words([t for t, _ in held], frozenset(), frozenset())
    want = {(i, *s[1]) for i, (_, s) in enumerate(held)}
    firsts = {(i, *s[0]) for i, (_, s) in enumerate(held)}
    got, alone = set(pii.mentions(words, f.decode(words))), set(pii.mentions(words, f.decode(words, coupled=False)))
    assert len(got & firsts) >= 95 and len(alone & firsts) >= 95
    right, wrong = len(got & want), len(got - want - firsts)
    right_alone, wrong_alone = len(alone & want), len(alone - want - firsts)
    assert right - wrong >= 60 and right_alone - wrong_alone <= 30


def test_tables(spark, field):
    texts = [(1, "Contact: Elif Kellor, phone +44 20 7946 0632. Bye."), (2, None), (3, ""), (4, " \n"), (1, "Contact: Elif Kellor, phone +44 20 7946 0632. Bye."), (5, "word " * 30_000 + "Contact: Zoé Kellor today.")]
    df = spark.createDataFrame([(*r, "x") for r in texts], "doc_id bigint, text string, surface string")
    got = {tuple(r) for r in pii.find_pii(df, field).collect()}
    assert got == {(1, "name", "Elif Kellor"), (1, "phone", "+44 20 7946 0632"), (5, "name", "Zoé Kellor")}
    clean = {(r.doc_id, r.clean_text) for r in pii.redact(df, field).collect() if r.doc_id < 5}
    assert clean == {(1, "Contact: [NAME], phone [PHONE]. Bye."), (2, None), (3, ""), (4, " \n")}
    assert pii.find_pii(df.limit(0), field).count() == 0


def test_long_texts_are_labelled_whole(spark, field):
    """A mention anywhere in a text beyond 48,000 characters is found as it stands, also where a blank of it is the first after a multiple of 24,000."""
    mention = "Contact: Zoé Kellor today"
    lead = ("word " * 5000)[: 24_000 - len("Contact: Zoé")]
    text = lead[:-1] + " " + mention + " word" * 12_000
    assert text.index(" ", 24_000) == text.index(" Kellor")
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [tuple(r) for r in pii.find_pii(df, field).collect()] == [(1, "name", "Zoé Kellor")]
    clean = pii.redact(df, field).first()
    assert clean.n_replaced == 1 and clean.clean_text == text.replace("Zoé Kellor", "[NAME]")


def test_chains_in_pieces_are_like_whole_ones(field):
    text = " ".join(t for t, _ in sentences(700, 9))
    words = pii.Words([text], GIVEN, FAMILY)
    assert len(words.tokens) > 2 * pii.PIECE + 4 * pii.MARGIN
    labels = field.decode(words)
    keep = pii.PIECE
    try:
        pii.PIECE = 10**9
        assert (field.decode(words) == labels).all()
    finally:
        pii.PIECE = keep


def test_fit_without_mentions():
    f = pii.fit(["nothing here at all"] * 5, GIVEN, FAMILY)
    words = pii.Words(["Elif Kellor"], GIVEN, FAMILY)
    assert not f.decode(words).any()


def test_known_names(spark):
    df = spark.createDataFrame([(["Elif Kellor", "Zoé  van Mardari", None, ""],), (None,)], "authors array<string>")
    given, family = pii.known_names(df)
    assert all(n in given for n in ("elif", "zoé")) and all(n in family for n in ("kellor", "mardari"))
    assert not any(n in given for n in ("kellor", "van", "stage")) and not any(n in family for n in ("elif", "van"))
    assert not any(n in pii.known_names(df.limit(0))[0] for n in ("elif", "a"))


def test_save_and_load(spark, field, tmp_path):
    held = pii.Field(field.weights, field.moves, field.ties, pii.NameFilter.of(GIVEN), pii.NameFilter.of(FAMILY))
    held.save(spark, f"file://{tmp_path}/field")
    back = pii.Field.load(spark, f"file://{tmp_path}/field")
    texts = [t for t, _ in sentences(50, 3)]
    words = pii.Words(texts, back.given, back.family)
    assert (back.decode(words) == held.decode(words)).all()


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"Contact: Elif Kellor, note {k}") for k in range(400)] + [(900, "x " * 9000), (901, None)], "doc_id bigint, text string")
    drawn = []
    fit, pii.fit = pii.fit, lambda texts, *a: drawn.append(texts)
    try:
        pii.fit_on(docs, GIVEN, FAMILY, rows=100)
        pii.fit_on(docs, GIVEN, FAMILY, rows=10_000)
        pii.fit_on(docs.limit(0), GIVEN, FAMILY)
    finally:
        pii.fit = fit
    assert 50 < len(drawn[0]) <= 100 and len(drawn[1]) > 350 and drawn[2] == [] and max(map(len, drawn[1])) < pii.SAMPLE_CHARS
