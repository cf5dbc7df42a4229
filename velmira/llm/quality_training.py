"""Labelled documents and the induction of the rule list (incremental reduced-error pruning).

The labelled documents are generated here from seeded templates in four languages: prose (wrapped, upper-case, with
headings, without full stops, with a short list or table inside), lists, tables and junk in many notations.  Their
number (``DOCUMENTS`` = 6,000) is the documented bound of the training sample.
"""

from __future__ import annotations

import random
import textwrap

import numpy as np
import pandas as pd

DOCUMENTS = 6000
ORDER = ("table", "list", "junk")
# sizes and digits tell the generator's habits rather than the kind of a text
UNUSED = ("n_chars", "n_tokens", "n_lines", "digit_share", "ended_share")

_NOUNS = {
    "en": "patient seizure episode signal lesion hippocampus aura response scan electrode dose registry clinic trial onset relapse fever gait cortex rhythm attack memory".split(),
    "de": "Patient Anfall Verlauf Signal Läsion Station Klinik Antwort Aufnahme Elektrode Dosis Gruppe Fieber Gangbild Rinde Rhythmus Müdigkeit Verwirrtheit".split(),
    "fr": "patient crise épisode signal lésion clinique réponse image électrode dose groupe fièvre marche cortex rythme fatigue confusion absence".split(),
    "es": "paciente crisis episodio señal lesión clínica respuesta imagen electrodo dosis grupo fiebre marcha corteza ritmo cansancio confusión ausencia".split(),
}
_FRAMES = {
    "en": (
        "The {a} was followed by {a} and the {b} had returned after {n} days.", "We found {n} cases in which the {a} was not related to the {b}.",
        "After {n} weeks of treatment the {a} fell to {n} per cent, but the {b} was the same as before.", "There were {n} records with {a} in the group from the {b}.",
        "It is not clear whether the {a} or the {b} came first in this series of {n}.", "During the night {a} set in with {b}, and {n} seconds later the {a} was gone.",
        "As for the {a}, it had been noted by the {b} but was not seen on this scan.", "These findings should be read with care, since the {a} was also common in the {b}.",
    ),
    "de": (
        "Nach {n} Tagen war der {a} nicht mehr mit dem {b} vereinbar.", "Wir haben {n} Verläufe aus der {a} verglichen und {b} am häufigsten gesehen.",
        "Unter der Behandlung mit {n} mg gingen {a} und {b} zurück, jedoch nicht bei den anderen.", "Es bleibt offen, ob {a} oder {b} zuerst im Alter von {n} Jahren begannen.", "Der {a} wurde von der {b} nicht mehr bemerkt, als er sich wieder zeigte.",
    ),
    "fr": (
        "Après {n} jours, le {a} était compatible avec la {b} de la série.", "Nous avons comparé {n} dossiers de la {a} et une {b} était le signe le plus fréquent.",
        "On ne sait pas si la {a} ou le {b} ont débuté en premier, à l'âge de {n} ans.", "Les {n} patients du groupe présentaient une {a} puis des {b} sur les images.", "La {a} n'était pas liée au {b}, mais elle est apparue avec la {b} dans la nuit.",
    ),
    "es": (
        "Después de {n} días el {a} no era compatible con la {b} de la serie.", "Comparamos {n} historias de la {a} y el {b} fue lo más frecuente en los casos.",
        "No está claro si {a} o {b} empezaron primero, a los {n} años de la paciente.", "El registro mostró {n} descargas por hora, mientras la {a} seguía con {b}.", "La {a} no se vio en la {b}, pero el {a} volvió por la noche con más fuerza.",
    ),
}
_OPEN = {"en": ("", "a ", "an old ", "mild "), "de": ("", "starke ", "kurze "), "fr": ("une ", "des ", "", "un "), "es": ("", "una ", "gran ")}
_MENU = "Home Menu Search Login Share PDF Cite Help Next Top Cookies Issue Back Print".split()


_SYLLABLES = "ba co du el fi ga ho in ka lo mi na or pe qui ra so ta um ve xi za bro cle dri sta tion men ver lax pam gyr".split()


def _noun(r: random.Random, lang: str) -> str:
    """A known word or an invented one, so that no rule can lean on how often words come back."""
    if r.random() < 0.5:
        return r.choice(_NOUNS[lang])
    word = "".join(r.choices(_SYLLABLES, k=r.randint(2, 4)))
    return word + (" " + "".join(r.choices(_SYLLABLES, k=r.randint(2, 3))) if r.random() < 0.4 else "")


def _sentence(r: random.Random, lang: str) -> str:
    phrase = lambda: " ".join(_noun(r, lang) for _ in range(r.choice((1, 2, 3, 4, 6))))
    return r.choice(_FRAMES[lang]).format(a=phrase(), b=phrase(), n=r.randint(2, 400))


def _item(r: random.Random, lang: str) -> str:
    word = r.choice(_OPEN[lang]) + _noun(r, lang)
    return word + (" " + _noun(r, lang) if r.random() < 0.3 else "") + (" of the " + r.choice(_NOUNS[lang]) if lang == "en" and r.random() < 0.08 else "")


def _list(r: random.Random, lang: str, n: int | None = None) -> str:
    n = n or r.choice((4, 6, 9, 14, 22, 40, 90))
    items = [_item(r, lang) for _ in range(n)]
    style = r.choice((0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9, 9, 10))
    if style == 10:
        items = [f"Annals of {_item(r, lang).title()} {r.randint(2, 60)}({r.randint(1, 12)}):{r.randint(1, 900)}-{r.randint(901, 1500)}" for _ in items]
    marks = ("* ", "- ", "• ", "{}. ", "({}) ", "{}) ", "   • ", "– ")
    if style < 8:
        return "\n".join(marks[style].format(i + 1) + x for i, x in enumerate(items))
    if style == 8:
        return "\n".join(items) if r.random() < 0.4 else "\n".join(f"{x}: {_item(r, lang)}" for x in items)
    if style == 9:
        return r.choice(("; ", ", ", " • ", "; ", ", ")).join(items)
    return "\n".join((f"[{i + 1}] " if r.random() < 0.8 else f"{i + 1}. ") + x for i, x in enumerate(items))


def _table(r: random.Random, lang: str, n: int | None = None) -> str:
    n, columns = n or r.choice((4, 6, 10, 18, 32)), r.randint(3, 7)
    numeric = [r.random() < 0.6 for _ in range(columns)]
    cell = lambda c: r.choice(("-", "n/a")) if r.random() < 0.05 else str(r.randint(1, 95)) if numeric[c] else _item(r, lang)
    rows = [[r.choice(("Age", "Sex", "Dose", "Drug", "MRI", "EEG", "Outcome", "Pt")) for _ in range(columns)]] + [[cell(c) for c in range(columns)] for _ in range(n)]
    style = r.randrange(6)
    if style == 0:
        lines = ["| " + " | ".join(x) + " |" for x in rows]
        lines.insert(1, "|" + "---|" * columns)
    elif style == 4:
        width = [max(len(x[c]) for x in rows) + 2 for c in range(columns)]
        lines = ["".join(v.ljust(w) for v, w in zip(x, width)).rstrip() for x in rows]
    else:
        lines = [{1: ",", 2: "\t", 3: "; ", 5: " | "}[style].join(x) for x in rows]
    return ("Table {}. {}\n".format(r.randint(1, 9), "Findings by patient") if r.random() < 0.3 else "") + "\n".join(lines)


def _prose(r: random.Random, lang: str) -> str:
    size = r.choice((2, 4, 8, 12, 20, 60))
    text = [_sentence(r, lang) for _ in range(size)]
    style = r.randrange(9)
    if style == 0:
        out = "\n".join(textwrap.wrap(" ".join(text), r.randint(40, 75)))
    elif style == 1:
        out = "\n\n".join(text)
    elif style == 2:
        out = " ".join(text).upper()
    elif style == 3:
        out = ", ".join(x.rstrip(".") for x in text)
    elif style == 4 and size >= 8:
        out = " ".join(text) + "\n\n" + _list(r, lang, r.randint(2, 4))
    elif style == 5 and size >= 8:
        out = " ".join(text[:4]) + "\n\n" + _table(r, lang, 2) + "\n\n" + " ".join(text[4:])
    elif style == 6:
        out = "\r\n\r\n".join((r.choice(("Results", "1. Background", "Discussion:")), " ".join(text)))
    elif style == 7:
        out = "\n".join(text)
    else:
        out = " ".join(text)
    return out


def _junk(r: random.Random, lang: str) -> str:
    n, style = r.choice((12, 20, 30, 80, 200, 400)), r.choice((0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9, 10, 11, 12, 13))
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    if style == 0:
        return pick("#$%&*+-/<=>?@\\^_|~…■□▲◆ \n", n * 6)
    if style == 1:
        return " ".join(pick("abcdefghijklmnopqrstuvwxyz", r.randint(1, 14)) for _ in range(n))
    if style == 2:
        return " ".join(pick("âÂ€Ã¼½ðŸœ™¤¶©¿�", r.randint(2, 8)) for _ in range(n))
    if style == 3:
        return pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", n * 8)
    if style == 4:
        return pick("xa0.-=_", 1) * (n * 5)
    if style == 5:
        return r.choice((" | ", " ", "\n", " · ")).join(r.choice(_MENU) for _ in range(n))
    if style == 6:
        return r.choice((" ", "\n", ", ")).join([r.choice(("null", "…", "test", "n/a", "0", "lorem", "NaN", "-", "EEG", "EEG EEG MRI", "no data here"))] * n)
    if style == 7:
        return " ".join([_sentence(r, lang)] * max(6, n // 6))
    if style == 8:
        return " ".join(pick("0123456789", r.randint(1, 9)) for _ in range(n))
    if style in (9, 10):
        def stir(word: str) -> str:
            letters = list(word)
            r.shuffle(letters)
            return "".join(letters)

        return " ".join(stir(w) for _ in range(max(2, n // 14)) for w in _sentence(r, lang).split())
    if style == 11:
        return " ".join(pick("iltrfnmou01|!;:.,'`", r.randint(1, 7)) for _ in range(n))
    if style == 12:
        return "\n".join([_sentence(r, lang)] * max(6, n // 6)) if r.random() < 0.5 else " ".join([_item(r, lang)] * n)
    return "\n".join(" ".join(r.choice(_MENU) for _ in range(r.randint(1, 3))) for _ in range(n))


def labelled(count: int = DOCUMENTS, seed: int = 7) -> pd.DataFrame:
    """``doc_id, text, label``."""
    r = random.Random(seed)
    make = {"prose": _prose, "list": _list, "table": _table, "junk": _junk}
    rows = []
    for i in range(count):
        label = r.choices(("prose", "list", "table", "junk"), (0.4, 0.2, 0.2, 0.2))[0]
        rows.append((i, make[label](r, r.choices(("en", "de", "fr", "es"), (5, 2, 2, 2))[0]), label))
    return pd.DataFrame(rows, columns=["doc_id", "text", "label"])


# ---- incremental reduced-error pruning ---------------------------------------------------------------------
def _covers(x: pd.DataFrame, rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for feature, sign, limit in rule:
        v = x[feature].to_numpy()
        ok &= v <= limit if sign == "<=" else v > limit
    return ok


def _grow(x: pd.DataFrame, y: np.ndarray, features) -> list:
    rule, inside = [], np.ones(len(x), bool)
    while (inside & ~y).any() and len(rule) < 6:
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        best, gain = None, 0.0
        for feature in features:
            v = x[feature].to_numpy()
            cuts = np.unique(np.quantile(v[inside], np.linspace(0.01, 0.99, 60)))
            cuts = np.unique(np.round((cuts[1:] + cuts[:-1]) / 2, 4)) if len(cuts) > 1 else cuts
            for limit in cuts:
                for sign in ("<=", ">"):
                    hit = inside & (v <= limit if sign == "<=" else v > limit)
                    p, n = (hit & y).sum(), (hit & ~y).sum()
                    if p:
                        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if g > gain + 1e-9:
                            best, gain = (feature, sign, float(limit)), g
        if best is None:
            break
        rule.append(best)
        inside &= _covers(x, [best])
    return rule


def _prune(x: pd.DataFrame, y: np.ndarray, rule: list) -> list:
    def worth(r):
        hit = _covers(x, r)
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    options = [rule[: i + 1] for i in range(len(rule))]
    return max(options, key=lambda r: (worth(r), -len(r))) if options else rule


def induce(x: pd.DataFrame, labels: np.ndarray, features, order=ORDER, seed: int = 1) -> tuple:
    """Ordered rules ``((label, ((feature, sign, limit), ...)), ...)``; what no rule takes is prose."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(x), bool)
    for label in order:
        failed = 0  # a rule that its pruning set rejects is tried again on two other divisions
        while failed < 3 and (left & (labels == label)).sum() >= 8:
            at = rng.permutation(np.flatnonzero(left))
            grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
            rule = _grow(x.iloc[grow], labels[grow] == label, features)
            rule = _prune(x.iloc[prune], labels[prune] == label, rule)
            hit = _covers(x.iloc[prune], rule)
            good, bad = (hit & (labels[prune] == label)).sum(), (hit & (labels[prune] != label)).sum()
            if not rule or good == 0 or bad > 0.05 * (good + bad):
                failed += 1
                continue
            rules.append((label, tuple(rule)))
            left &= ~_covers(x, rule)
    return tuple(rules)


def apply(x: pd.DataFrame, rules, default: str = "prose") -> np.ndarray:
    out, left = np.full(len(x), default, dtype=object), np.ones(len(x), bool)
    for label, rule in rules:
        hit = left & _covers(x, rule)
        out[hit] = label
        left &= ~hit
    return out


def train(spark, count: int = DOCUMENTS, seed: int = 13):
    """(rules, held-out accuracy): the first ``count`` generated documents train, half as many more are held out."""
    from velmira.llm.quality import FEATURES, statistics

    used = [f for f in FEATURES if f not in UNUSED]
    docs = labelled(count + count // 2, seed)
    stats = statistics(spark.createDataFrame(docs[["doc_id", "text"]])).toPandas()
    m = docs.merge(stats, on="doc_id").sort_values("doc_id")
    fit, held = m.iloc[:count].reset_index(drop=True), m.iloc[count:]
    rules = induce(fit, fit["label"].to_numpy(), used)
    return rules, float((apply(held, rules) == held["label"].to_numpy()).mean())


if __name__ == "__main__":
    from velmira.session import local_session

    learned, accuracy = train(local_session())
    print("accuracy on held-out documents:", accuracy)
    print("RULES = (")
    for entry in learned:
        print(f"    {entry!r},")
    print(")")
