"""Problem 2 where all that is garbled turned into characters that sound text has, too."""

from __future__ import annotations

import pytest
from test_pages import repairer  # noqa: F401


@pytest.mark.parametrize("sign", ["—", "–", "“"])
@pytest.mark.parametrize("text", ["Nobody there knew {} or so it was said {} what to do next.", "Die Größe {} für die Übung {} war klar."])
def test_only_signs_are_garbled(repairer, text, sign):  # noqa: F811
    garbled = text.format(sign.encode().decode("cp1252"), sign.encode().decode("cp1252"))
    assert repairer.text("A first line.\n" + garbled) == ("A first line.\n" + text.format(sign, sign), 1)


def test_signs_that_are_right(repairer):  # noqa: F811
    for sound in ("He wrote «a {} b» there.", "РІК І РІЧКА", "Раз — там, тех рад.", "“One” – two — three", "château €5 ”quoted”"):
        sound = sound.replace("{}", "—".encode().decode("cp1252"))
        assert repairer.text(sound) == (sound, 0)


@pytest.mark.parametrize(("true", "wrong"), [("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251")])
def test_all_letters_stay_letters(repairer, true, wrong):  # noqa: F811
    text = "возле этого места недавно покрасили дом и сад"
    assert repairer.text(text.encode(true).decode(wrong)) == (text, 1)
    assert repairer.text(text.upper()) == (text.upper(), 0)


def test_trigrams_leave_out_nothing(repairer):  # noqa: F811
    """The same is found if every candidate of every line is compressed."""
    from tesserae.llm import encoding

    texts = ["Nobody there knew what to do next.", "Пешком отсюда до них идти около часа, если не мешают ни дом, ни сад.", "Größe für Übung", "Возле этого места", "a — b"]
    for true in ("utf-8", "koi8-r", "cp866", "cp1251"):
        for wrong in ("cp1251", "koi8-r", "latin-1"):
            for text in texts[:]:
                garbled = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(true, "ignore"))
                if garbled.isascii():
                    continue
                steps = [s for s, g in zip(encoding.ALL_STEPS, repairer.gains([garbled])[0], strict=True) if g >= repairer.costs[s, False]]
                assert repairer.best(garbled, steps, None) == repairer.best(garbled, encoding.ALL_STEPS, None), (garbled, true, wrong)


def test_words_of_question_marks(repairer):  # noqa: F811
    assert repairer.text("??????: ???? ·\nsound") == ("??????: ???? ·\nsound", 1)
    assert repairer.text("What??? No??? Yes ???") == ("What??? No??? Yes ???", 0)
