"""Every letter of a text counts, wherever white space stands."""

import numpy as np

from tracewell.llm import packing, toxicity

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pra", "sti", "vo") for b in ("n", "ra", "tel", "shu", "kig", "d")]
HAN = [chr(0x4E00 + i) for i in range(300)]


def test_every_letter_is_in_a_word():
    for text in ("you,idiot great—idiot and/or/idiot x2y 12 --", "漢" * 50 + "、字典", "Donaudampfschifffahrtsgesellschaft"):
        places = toxicity.places(text)
        assert {i for i, c in enumerate(text) if c.isalpha()} <= {i for _, a, b in places for i in range(a, b)}
        assert toxicity.tokens(text) == [w for w, _, _ in places]
        assert all(text[a:b] == w.lstrip(toxicity.MARK) for w, a, b in places)


def test_toxic_words_after_the_first_run():
    r, texts, y = np.random.default_rng(4), [], []
    for i in range(300):
        toxic = i % 3 == 0
        if i % 2:
            ws = list(r.choice(WORDS, 30))
            ws[10] += ",idiotic" if toxic else ",nice"
            texts.append(" ".join(ws))
        else:
            letters = list(r.choice(HAN, 80))
            letters[41:43] = "鬼魔" if toxic else letters[41:43]
            texts.append("".join(letters))
        y.append(float(toxic))
    model = toxicity.ToxicField().fit(texts[:200], np.array(y[:200]))
    got = np.array(model.score(texts[200:])) >= toxicity.THRESHOLD
    assert (got == (np.array(y[200:]) == 1)).mean() > 0.95
    a, b, _ = model.spans("".join(HAN[:20]) + "鬼魔" + "".join(HAN[30:50]))[0]
    assert a <= 21 and b >= 21


def test_runs_of_ascii_texts():
    """The faster pattern for lower-case ASCII finds the runs that the one for all texts does, and the ids are the plain call's."""
    encoder = packing.Encoder(packing.tokenizer_path())
    r, signs = np.random.default_rng(9), [chr(i) for i in range(128)]
    texts = ["".join(r.choice(signs, 200)).replace("<|", "<") for _ in range(50)] + ["A b2_c,d\x0b\x1f--e's 3.5\r\nf", ""]
    for text in texts:
        assert encoder.ASCII_RUN.findall(text.lower()) == encoder.RUN.findall(text.lower())
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
