"""The small labelled table that the field of operator 11 is trained from.

A row is a sentence; [kind words] marks a span. A tilde before a word stands for an
invented one of the same case, a digit for any digit: :func:`drawn` puts others in their
place, and words that hold nothing around the sentence. Rows without marks, and
:func:`plain` rows of invented words, numbers and keys, show what isn't personal.
"""

from __future__ import annotations

import random
import re

KINDS = ("address", "id", "name", "tel")

ROWS = [
    "My name is [name ~Maria ~Lopez] and I live nearby.",
    "my name is [name ~John ~Smith], thanks",
    "Hello, my name is [name ~Jane ~Miller] and I write to you.",
    "I am [name ~Robert ~Hall], the new clerk.",
    "Dear [name ~Anna], we have your letter.",
    "Dear Mr. [name ~Brown], your order is ready.",
    "Dear Mrs. [name ~Emily ~Clark],",
    "Please ask for Dr. [name ~Weber] at the desk.",
    "Mr. [name ~Peter ~Jones] has signed the form.",
    "Ms. [name ~Olsen] will call you back.",
    "Signed by [name ~Thomas ~Reed] on 12.04.2019.",
    "Patient: [name ~Laura ~Stone], born 03.05.1980",
    "Contact: [name ~David ~Moore]",
    "Name: [name ~Karen ~Young]",
    "Customer name: [name ~Paul ~Adler] (new)",
    "Mein Name ist [name ~Hans ~Richter].",
    "Sehr geehrter Herr [name ~Schulz], vielen Dank.",
    "Sehr geehrte Frau [name ~Eva ~Krause],",
    "Herr [name ~Otto ~Lang] kommt morgen.",
    "Frau [name ~Petra ~Neumann] wohnt hier.",
    "Ich heiße [name ~Jonas ~Beck].",
    "Frau Dr. [name ~Vogel] ist heute da.",
    "Je m'appelle [name ~Claire ~Dubois].",
    "Monsieur [name ~Bernard] est absent.",
    "Madame [name ~Sophie ~Martin] a appelé.",
    "Cher Monsieur [name ~Petit], merci.",
    "Me llamo [name ~Pablo ~Torres] y vivo aquí.",
    "Señor [name ~Garcia], gracias por todo.",
    "Estimada señora [name ~Elena ~Ruiz]:",
    "Mi nombre es [name ~Luis ~Ortega].",
    "call me at [tel 555-201-3344] today",
    "Call [tel 555-201-3344] please.",
    "call [tel (212) 555-1234] now",
    "call us: [tel (0711) 123456]",
    "or phone [tel 0207 946 0958].",
    "Phone: [tel (020) 7946 0958]",
    "Phone: [tel 020 7946 0958]",
    "tel. [tel 0171 2345678]",
    "Tel: [tel 030/1234567]",
    "Telefon: [tel 0711-123456]",
    "my number is [tel 555-0142]",
    "phone number [tel 212-555-0199], ask for me",
    "Tél. [tel 01 42 68 53 00]",
    "téléphone : [tel 06.12.34.56.78]",
    "teléfono: [tel 612 345 678]",
    "llámame al [tel 912 345 678] por favor",
    "fax [tel (030) 555-1234]",
    "mobile [tel 0151 23456789] or mail",
    "I live at [address 12 ~Baker Street], thank you.",
    "Address: [address 44 ~Green Road]",
    "Send it to [address 7 ~Park Avenue] please",
    "our office at [address 120 ~Hill Lane] is open",
    "Anschrift: [address ~Hauptstraße 5]",
    "Ich wohne in der [address ~Gartenstraße 17].",
    "Adresse: [address ~Bahnhofstr. 21]",
    "wohnhaft [address ~Lindenweg 3]",
    "Sie wohnt [address ~Kirchstraße 12] in Bonn",
    "wohnt in der [address ~Talstraße 8]",
    "She lives at [address 5 ~Mill Street] now",
    "Adresse : [address 10 rue de la ~Paix]",
    "j'habite [address 25 avenue ~Foch]",
    "domicilié [address 3 rue ~Victor]",
    "vivo en [address calle ~Mayor 3]",
    "Dirección: [address calle de ~Alcalá 45]",
    "con domicilio en [address avenida ~Sol 12]",
    "SSN [id 123-45-6789]",
    "social security number: [id 321-54-9876].",
    "passport no. [id X1234567]",
    "Passport number [id C4532198], valid",
    "driver license [id D1234567]",
    "Reisepass [id C01X0006H]",
    "Personalausweis: [id L01X00T47]",
    "passeport n° [id 09AB12345]",
    "DNI [id 12345678Z]",
    "mi DNI es [id 87654321X].",
    "NIE: [id X1234567L]",
    "IBAN [id DE89370400440532013000]",
    "IBAN: [id GB29NWBK60161331926819],",
    "account number [id 12345678] at the bank",
    # Nothing personal from here on.
    "The order of 12 items costs 345.50 today.",
    "In 1998 there were 4500 of them.",
    "~Over 30 streets were closed on Monday.",
    "the street was empty and the road was long",
    "die straße war leer",
    "la calle era larga y la rue aussi",
    "name of the thing is not known",
    "the number is large and the phone is new",
    "my dear friend came to the passport office",
    "Dear all, the account is closed.",
    "Frau und Herr sind Wörter.",
    "Tel Aviv is a city.",
    "call the number on page 12",
    "version 10.2.3 of 2020-01-05",
    "Mr. and Mrs. are titles.",
    "see section 4.1 and table 12",
    "Copyright 2019 the authors, all rights reserved.",
    "Licensed under the Apache License, Version 2.0",
    "call me later, my name is short",
    "the address is wrong",
]

_SYLLABLES = "an ar ba be chen da de el en er es ha he ing ion ka la le lo ma men mi na no on or ra re ri sa se si ta te ti to un ver vi wa za ía ó ü é ñ ß".split()
_MARK = re.compile(r"\[(\w+) ([^\]]*)\]")


def invented(rng: random.Random, case: str = "x", least: int = 1) -> str:
    word = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(least, 5)))
    return word.capitalize() if case == "Xx" else word.upper() if case == "X" else word


def _filled(words: list[str], rng: random.Random) -> list[str]:
    out = []
    for w in words:
        if "~" in w:
            core = re.search(r"~(\w+)", w)[1]
            tail = next((t for t in ("straße", "weg", "str") if core.lower().endswith(t) and core.lower() != t), "")
            w = re.sub(r"~\w+", invented(rng, "Xx", 2) + tail, w)
        out.append(re.sub(r"[0-9]", lambda m: rng.choice("0123456789"), w))
    return out


def plain(rng: random.Random, n: int) -> list[str]:
    """n words that hold nothing personal: invented ones, sentence ends, shouting, numbers, keys, and what the base patterns find."""
    out: list[str] = []
    mode, start = rng.randrange(8), True
    common = "de la el der die das und the of and at is for in on to no en et le que los un a".split()
    if mode == 3:  # junk: a word again and again
        word = rng.choice([rng.choice(common), rng.choice(common).capitalize(), invented(rng), invented(rng, "Xx")])
        return [word] * n
    while len(out) < n:
        x = rng.random()
        if x < 0.12:
            out.append(rng.choice(common))
            continue
        x = rng.random()
        if x < 0.03:
            out.append("".join(rng.choice("0123456789") for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 10, 16)))) + rng.choice(["", "", ".", ","]))
        elif x < 0.04:
            out += ["+1", "({}) ".format(rng.randrange(100, 999)).strip(), f"555-{rng.randrange(1000, 9999)}"]
        elif x < 0.05:
            out.append(f"{invented(rng)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com")
        elif x < 0.06:
            out.append(".".join(str(rng.randrange(256)) for _ in range(4)))
        elif x < 0.065:
            out += ["token", "=", '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
        else:
            w = invented(rng, "X" if mode == 0 else "Xx" if start or rng.random() < 0.04 else "x")
            end = rng.choice(["!!", "!", "%%%", "$$$", "###"]) if mode in (0, 1) and rng.random() < 0.7 else rng.choice([".", ",", "", "", "", "", "", "", "", ""])
            start = end in (".", "!", "!!")
            out.append(w + end)
            if mode == 2 and rng.random() < 0.5:
                out.append("|")
    return out[:n]


def drawn(rows: list[str] = ROWS, times: int = 6, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of every row, `times` times with other fillings and surroundings, and as many plain rows; labels O, B-kind, I-kind."""
    rng, out = random.Random(seed), []
    for row in rows:
        for _ in range(times):
            words, labels, at = [], [], 0
            for m in [*_MARK.finditer(row), None]:
                gap = _filled(row[at : m.start() if m else len(row)].split(), rng)
                if words and gap and at and not row[at].isspace():  # what follows a mark directly belongs to its last word
                    words[-1] += gap.pop(0)
                words += gap
                labels += ["O"] * (len(words) - len(labels))
                if m:
                    own = _filled(m[2].split(), rng)
                    words += own
                    labels += [f"B-{m[1]}"] + [f"I-{m[1]}"] * (len(own) - 1)
                    at = m.end()
            before, after = plain(rng, rng.randrange(6)), plain(rng, rng.randrange(6))
            out.append((before + words + after, ["O"] * len(before) + labels + ["O"] * len(after)))
            free = plain(rng, rng.randrange(4, 26))
            out.append((free, ["O"] * len(free)))
    return out
