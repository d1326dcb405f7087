import pytest

from traceloom.llm import line_spam as Q

PROSE = "The review board approved the result of the vibration campaign and asked for a second measurement. "
SPAM = {
    "links": "\n".join(f"https://www.shop{i}.example/a-b/{i}" for i in range(20)),
    "labelled links": "\n".join(f"- brake sensor: https://shop.example/{i}" for i in range(9)),
    "inline links": " ".join(f"[oil pump {i}](http://x.test/{i})" for i in range(12)),
    "tags": " ".join(f"#WiperMotor{x}" for x in ("Sale", "Price", "Best", "Top", "Online", "Buy") * 3),
    "commas": "oil pump, spark plug, " * 30 + "oil pump",
    "rows": "\n".join(f"LUMEN-{630 + i} | safety kit | inlet | 2025 | brake sensor" for i in range(9)),
    "phrases": "\n".join(f"{x} wiper motor {y}" for x in ("buy", "cheap", "top", "best") for y in ("online", "2025", "near me", "price")),
    "stuffed": "Looking for tyre deal? Tyre deal here, tyre deal there, top tyre deal. Our tyre deal is the best tyre deal for every tyre deal buyer. " * 6,
    "german": "\n".join(f"{x} Bremssensor {y}" for x in ("sale", "top", "discount") for y in ("price", "2025", "review", "buy")),
    "french": "caméra de recul, pompe à huile, calculateur pas cher, " * 12 + "phare led",
    "french rows": "\n".join(f"CEDAR-{i}76 | pompe à huile | delta | cheap | caméra de recul" for i in range(9)),
    "french run": "pompe à huile caméra de recul calculateur pas cher capteur de frein " * 9,
    "french lines": "\n".join(f"{x} caméra de recul {y}\ncalculateur pas cher" for x in ("top", "best", "buy") for y in ("sale", "2025", "price")),
    "with a sentence": PROSE + "\n\n" + "oil pump; spark plug; " * 30 + "oil pump",
}
FINE = {
    "prose": PROSE * 8,
    "ends in keywords": PROSE * 8 + "\nKeywords: oil pump, safety kit, spark plug, seat heater",
    "ends in links": PROSE * 8 + "\nSee also\nhttps://a.example/1\nhttps://a.example/2",
    "matrix": "\n".join(f"WP-{1000 + i} | part_3:{i % 9 + 1}.2 | verified" for i in range(30)),
    "matrix with commas": "\n".join(f"WP-{1000 + i},part_3:{i % 9 + 1}.2,open" for i in range(30)),
    "checklist": "\n".join(f"Yes / No: Has the {x} of the design been approved? Checked: yes" for x in "list plan result sequence wording answer".split()),
    "glossary": "\n".join(f"{x} margin: safety-related elements that delay a loss of communication" for x in "thermal braking supplier".split()),
    "log": "\n".join(f"14:26:0{i}.448 ERR  headlamp_governor u=11.4V t=10{i}°C limit" for i in range(9)),
    "references": "\n".join(f"[{i}] Evidence of the battery observer, issue {i}, https://a.example/{i}" for i in range(1, 12)),
    "japanese": "試験台25では通信途絶を再現できなかった。運転者が介入しない限り、通信途絶を記録すること。" * 5,
    "german template": "\n".join(f"Der {x} muss den Zustand innerhalb von {i}{i} ms erkennen." for i, x in enumerate("Bremsregler Lenkwächter Pumpenschätzer Momentenbegrenzer Batteriemonitor Kameraempfänger".split())),
    "wrapped prose": "\n".join("The review board approved the result of|the vibration campaign and asked for a|second measurement of the climate chamber|before the next gate of the programme".split("|")) + "\nand closed it",
    "headings only": "Scope\nPurpose\nResults",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert Q.judge(SPAM[name])[0], Q.judge(SPAM[name])


@pytest.mark.parametrize("name", FINE)
def test_fine(name):
    assert not Q.judge(FINE[name])[0], Q.judge(FINE[name])


@pytest.mark.parametrize("text", [None, "", "  \n ", ".", "tbd", "﻿", "buy now"])
def test_little(text):
    assert not Q.judge(text)[0]


def test_frame(spark):
    rows = [(1, SPAM["commas"], "x"), (1, SPAM["commas"], "y"), (2, None, "z"), (3, FINE["prose"] * 500, "q"), (4, SPAM["links"] * 200, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(r.doc_id for r in Q.spam_pages(df).collect()) == [1, 4]
    assert Q.spam_pages(df.limit(0)).collect() == [] and sum(r.n_pages for r in Q.shape_report(df).collect()) == 5


def test_short_mixed_and_dated_pages():
    words = "oil pump", "spark plug", "brake sensor"
    assert Q.judge(" ".join(f"#{x}{y}" for x in ("Oil", "Brake") for y in ("Pump", "Sale", "Price", "Top", "Buy")))[0]
    assert Q.judge("\n".join(f"{w} {mark} {v} {mark} {w}" + f" {mark} {v}" * n for mark in ("|", ";", "•", "/") for n in (0, 3, 7) for w, v in zip(words, words[1:])))[0]
    assert Q.judge("\n".join("safety kit | 2024 | brake sensor | 2019" for _ in range(9)))[0]
    assert not Q.judge("Scope\nPurpose\nhttps://a.example/1")[0]


def test_few_words(spark):
    assert Q.judge("brake pads\nbrake pads\nbrake pads")[0] and Q.judge("pump, valve, pump, valve")[0]
    assert not Q.judge("Hazard review")[0] and not Q.judge("pump, valve, seal")[0]
