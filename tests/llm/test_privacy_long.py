import time

import pytest

from wayline.llm import privacy

PARTS = ["@", "a@", "a@b", "a@b.", "+1", "1", "1.", "1.1.1.1.", "1 ", "1-", "AA0", "AA00 ", "A0 ", *privacy.SCHEMES, *(s + "u" for s in privacy.SCHEMES), *(s + "u@h.c " for s in privacy.SCHEMES), *privacy.CUES[:6], "iban: 1", "iban 1 ", *(c + ": " for c in privacy.PLACE_CUES[:4]), "address: 1 St, ", "address: A "]


@pytest.mark.parametrize("part", PARTS)
def test_a_long_text_takes_time_in_proportion(part):
    text = part * (60_000 // len(part))
    began = time.process_time()
    privacy.find_spans(text)
    privacy.find_spans(text + "@")
    privacy.find_spans(text + "x@" + "h" * 100_000)
    assert time.process_time() - began < 6


def test_schemes_within_a_user():
    text = "mailto:mailto:a@b.org mailto:x:mailto:y mailto:q@r http://u:p@h.org/x,mailto:s@t.de."
    assert [text[s:e] for k, s, e in privacy.find_spans(text) if k == "url"] == ["mailto:mailto:a@b.org", "http://u:p@h.org/x,mailto:s@t.de"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Address: 1600 Pennsylvania Avenue NW, Washington, DC 20500. Call", "1600 Pennsylvania Avenue NW, Washington, DC 20500"),
        ("her home address: 12 Baker St., London and", "12 Baker St., London"), ("he lives at 7b Elm Road with his", "7b Elm Road"), ("ADDRESS: P.O. Box 1234, Reno", "P.O. Box 1234, Reno"),
        ("Adresse : 12 bis rue de la Paix, 75002 Paris; tél", "12 bis rue de la Paix, 75002 Paris"), ("demeurant au 3 allée d'Auteuil et", "3 allée d'Auteuil"),
        ("Anschrift: Lange Straße 12a, 10115 Berlin. Bitte", "Lange Straße 12a, 10115 Berlin"), ("wohnhaft in Gartenstr. 5, 80331 München\nTel", "Gartenstr. 5, 80331 München"),
        ("Dirección: Calle Mayor, 12, 28013 Madrid", "Calle Mayor, 12, 28013 Madrid"), ("con domicilio en Avda. de los Reyes 7, Sevilla.", "Avda. de los Reyes 7, Sevilla"),
        ("address: see below", None), ("address the 12 Street gangs", None), ("email address: a@b.co", None), ("Adresse: rue de la Paix", None), ("preaddress: 1 Elm Road", None), ("address 0x12", None), ("address:", None),
    ],
)
def test_postal_addresses_of_four_languages(text, want):
    assert [text[s:e] for k, s, e in privacy.find_spans(text) if k == "postal"] == ([want] if want else [])
