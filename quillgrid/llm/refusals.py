"""Refusals, by aligning responses with templates of slots.

A template is a row of slots, each a set of words, with room for a few free words between
them. A sentence declines if a template aligns with it, what it leaves uncovered is short
and free of numbers, and it neither goes on to an answer nor says that the table lacks the
value. A response is a refusal if a sentence declines and every other is such a one or a
courtesy.
"""

from __future__ import annotations

import re

# ---- fixed values -------------------------------------------------------------------------
#: Acts of answering, by language.
ACTS = {
    "en": "help assist answer answering comply provide respond reply transcribe process do fulfil fulfill complete continue support share discuss engage view reading assisting helping complying accommodate carry proceed",
    "de": "helfen weiterhelfen beantworten antworten sagen unterstützen bearbeiten erfüllen leisten nachkommen entsprechen bereitstellen äußern verarbeiten",
    "fr": "aider répondre traiter fournir satisfaire transcrire assister donner accéder poursuivre",
    "es": "ayudar ayudarle ayudarte responder contestar atender procesar proporcionar transcribir cumplir asistir asistirle continuar complacer",
}
#: Slots are divided by blanks; | stands between words of a slot, a number before a slot is the free words allowed there, @ the acts.
TEMPLATES = {
    "en": [
        "i|we can't|cannot|won't|couldn't|wouldn't 2@", "i|we can|will|could|do|am|would not 3@", "i'm|am|are|we're not|unable 4@", "cannot|can't|unable 1@ that|this|with|you|your",
        "i|we 1won't|will 1be able 1@", "i|we 2decline|refuse 2to|this|that|your|the", "i|we|i'd|we'd|would 1rather|prefer 1not 2@|say|to", "i|we don't|do|not 1feel|comfortable 3@",
        "isn't|not 1something|anything i|we can|could|will|am", "i'm|am|are 1not 1allowed|permitted|authorized|supposed 2@", "i|we 1abstain|refrain 1from",
    ],
    "de": [
        "ich|wir 1kann|können|darf|dürfen|werde|möchte|will 5nicht|nichts|keine|kein 4@", "kann|können|darf|dürfen|werde|möchte ich|wir 5nicht|nichts|keine|kein 4@",
        "ich|wir 1muss|müssen|möchte 5ablehnen|verweigern|verzichten", "muss|müssen|möchte ich|wir 5ablehnen|verweigern|verzichten", "ich|wir lehne|lehnen 4ab", "lehne|lehnen ich|wir 4ab", "bin|sind 2nicht in 1lage 6@", "weigere|weigern 1mich|uns",
    ],
    "fr": [
        "ne|n peux|pouvons|puis|pourrai|saurais 2pas 3@", "ne|n suis|sommes 1pas 2mesure|autorisé|autorisée|capable|habilité 3@", "je|nous 1dois|devons|préfère|préférons 2refuser|décliner|abstenir", "je|nous refuse|refusons|décline|déclinons 2de|cette|votre|ce", "m'est|est 1impossible 2de|d 1@",
    ],
    "es": [
        "no 1puedo|podemos|podré|podría 3@", "no 1me|nos es|resulta posible 3@", "debo|debemos|prefiero|tengo|tenemos 2rechazar|declinar|negarme", "rechazo|rechazamos|declino 2esta|este|la|tu|su", "no 1estoy|estamos 4@", "prefiero|preferimos no 2@",
    ],
}
#: Chinese: refusing words, followed within a few characters by an act; or a refusal itself.
CHINESE = re.compile(r"(?:无法|不能|不便|不可以|没办法|没有办法|不愿)[^。！？，；]{0,10}(?:回答|回应|答复|帮助|帮忙|协助|帮您|帮你|处理|完成|提供|满足|讨论)|(?:必须|只能|不得不|选择|需要)[^。！？，；]{0,2}(?:拒绝|谢绝)|(?:我|本助手)(?:拒绝|谢绝)")
#: Courtesies around a refusal, and what a refusing assistant calls itself and its reasons.
COURTESY = set(
    "sorry apologies apologize afraid regret unfortunately please thank thanks anything else something understand understanding guidelines guideline policy policies ai assistant instead another happy glad "
    "leid entschuldigung entschuldigen leider bitte verständnis danke gern gerne richtlinien stattdessen "
    "désolé désolée pardon malheureusement excuses regrette merci compréhension veuillez directives "
    "siento lamento disculpa disculpe disculpas desgracia lamentablemente gracias comprensión favor directrices".split()
)
CHINESE_COURTESY = re.compile(r"对不起|抱歉|不好意思|请|感谢|谢谢|谅解|理解|话题|遗憾")
#: A word after the refusal that brings an answer, and words that say what a table lacks.
TURNS = set("but however though still yet nevertheless aber jedoch dennoch doch mais toutefois cependant pero sino aunque obstante".split())
CHINESE_TURNS = re.compile(r"但|不过|然而")
LACKS = set(
    "missing lacks lack contain contains include includes list lists listed show shows shown absent available mention mentions mentioned given data enthält enthalten fehlt fehlen aufgeführt angegeben vorhanden contient manque manquante figure indique absente contiene falta faltan figura indica aparece".split()
)
CHINESE_LACKS = re.compile(r"没有(?:给出|列出|包含|提供|显示|标|记|该|这|数)|缺|未(?:给出|列出|包含|提供|显示|标|记)|不含")
#: Free words that a declining sentence and a courtesy may have.
FREE_WORDS, FREE_CHARACTERS = 12, 24

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
_CJK = re.compile(r"[㐀-鿿]")
_SENTENCE = re.compile(r"(?<=[.!?。！？;；])\s*(?=\S)|\n+")


def _parse(template: str, language: str) -> tuple[tuple[int, frozenset[str]], ...]:
    slots = []
    for slot in template.split():
        room = int(slot[0]) if slot[0].isdigit() else 0
        words = slot[1:] if slot[0].isdigit() else slot
        slots.append((room, frozenset(w for x in words.split("|") for w in (ACTS[language].split() if x == "@" else [x]))))
    return tuple(slots)


_PARSED = [_parse(t, l) for l, ts in TEMPLATES.items() for t in ts]
_BY_START: dict[str, list] = {}
for _t in _PARSED:
    for _w in _t[0][1]:
        _BY_START.setdefault(_w, []).append(_t)


def align(tokens: list[str]) -> tuple[int, int] | None:
    """(begin, end) of the first place where a template's slots lie one after another, as near as they may."""
    for i, token in enumerate(tokens):
        for template in _BY_START.get(token, ()):
            at = i
            for room, words in template[1:]:
                at = next((k for k in range(at + 1, min(at + 2 + room, len(tokens))) if tokens[k] in words), -1)
                if at < 0:
                    break
            else:
                return i, at + 1
    return None


def tokens_of(text: str) -> list[str]:
    return [p for w in _TOKEN.findall(text.lower().replace("’", "'")) for p in ((w,) if not w.startswith(("n'", "d'", "l'", "j'")) else w.split("'"))]


def kind_of(sentence: str) -> str:
    """'declines', 'courtesy', 'blank' or 'other'."""
    if len(_CJK.findall(sentence)) >= 2:
        hit = CHINESE.search(sentence)
        digits = re.search(r"\d", sentence)
        if hit and not digits and not CHINESE_LACKS.search(sentence) and not CHINESE_TURNS.search(sentence[hit.end() :]) and len(sentence) - (hit.end() - hit.start()) <= FREE_CHARACTERS:
            return "declines"
        return "courtesy" if CHINESE_COURTESY.search(sentence) and not digits and len(sentence) <= FREE_CHARACTERS else "other"
    tokens = tokens_of(sentence)
    if not tokens:
        return "blank"
    if any(t.isdigit() for t in tokens):
        return "other"
    span = align(tokens)
    if span:
        rest = tokens[: span[0]] + tokens[span[1] :]
        if len(rest) <= FREE_WORDS and not LACKS & set(rest) and not TURNS & set(tokens[span[1] :]):
            return "declines"
    return "courtesy" if COURTESY & set(tokens) and len(tokens) <= FREE_WORDS and not LACKS & set(tokens) else "other"


def is_refusal(response: str) -> bool:
    """Whether the response declines and gives no answer. Whole responses are read, sentence by sentence, up to the first that is neither."""
    declined = False
    for sentence in _SENTENCE.split(response):
        kind = kind_of(sentence)
        if kind == "other":
            return False
        declined |= kind == "declines"
    return declined
