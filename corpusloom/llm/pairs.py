"""Defective prompt and response pairs (problem 3).

Method: a linear-chain conditional random field tags each clause of an answer as answer, refusal, echo
of the question, foreign or unfinished; the share of the answer's text that each tag covers gives
the pair's defect. Clauses are sentences, lines and fenced code blocks.

The field is trained here, on a bounded sample of the pairs (`SAMPLE`, by hash of the id): answers that
show no sign of a defect are taken as they are, and are also turned into every defect by cutting
them, by putting the question or an answer in another language in their place, or by putting a
refusal made from phrases of each language. The field is trained in rounds, so that it finds the sample's own refusals by the words that they share with these and learns their other words. Languages are told apart by a naive Bayes model of
character trigrams and words, trained on the same sample. Both models are of fixed size.

Defined cases: the answer is `response`, or `output` where that is null; null, blank and stand-in answers
are `empty`; a null question makes copying and language undecidable, not the rest; rows repeated
under one id give one row; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .budget import language_code
from .forms import visual_form

#: Pairs that both models are trained on, at most.
SAMPLE = 5000
EPOCHS = 9
#: Rounds in which the field is trained, each on what the one before has found in the sample.
ROUNDS = 3
#: Expected share of an answer's text that refuses, from which it is a refusal; and from which it is no example of a sound answer.
REFUSED, DOUBTFUL = 0.3, 0.12
#: Clauses above which a made example isn't trained on; all answers are tagged whole.
LONGEST = 24
DIMENSIONS = 1 << 16
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DEFECTS = {REFUSAL: "refusal", ECHO: "copied", FOREIGN: "language", UNFINISHED: "truncated"}

# Stand-ins for an absent answer, lower-cased and without blanks, brackets, quotes and other punctuation.
STAND_INS = {
    "", "na", "none", "null", "nan", "nil", "empty", "noanswer", "noresponse", "nooutput", "missing", "undefined", "tbd", "todo", "blank", "nodata", "void",
    "ninguno", "vacio", "vacío", "leer", "keine", "keineantwort", "vide", "aucun", "aucune", "sansréponse", "pasderéponse", "sinrespuesta", "vazio", "nenhum", "nenhuma", "semresposta",
    "нет", "пусто", "нетответа",
}

# Openings, cores and endings of refusals, by language; {} is the question's subject.
REFUSALS = {
    "en": (
        ("", "I'm sorry, but ", "Sorry, ", "Unfortunately ", "Regrettably, ", "My apologies: ", "As an AI, ", "As a language model, ", "Thanks for asking. ", "Hm. "),
        ("I can't help with {}", "I cannot assist with {}", "I am unable to respond to {}", "I must refuse {}", "I must decline {}", "I won't be giving an answer to {}", "I'd rather leave {} unanswered",
         "this question is outside what I may talk about", "no answer to {} can be given here", "I'm not able to answer {}", "I will not discuss {}", "I do not feel comfortable answering {}"),
        ("", "Please ask an expert instead.", "Thank you for understanding.", "Is there anything else you would like to talk about?", "Let me know if I can help with something else."),
        ("this question", "this request", "that", "the matter of {}"),
    ),
    "de": (
        ("", "Es tut mir leid, ", "Leider nicht: ", "Leider ", "Danke für die Frage. ", "Entschuldigung, "),
        ("bei {} kann ich nicht helfen", "ich kann {} nicht beantworten", "dazu darf ich nichts sagen", "ich muss {} ablehnen", "auf {} kann ich keine Antwort geben", "zu {} möchte ich mich nicht äußern", "ich werde {} nicht beantworten"),
        ("", "Kann ich bei etwas anderem helfen?", "Bitte wenden Sie sich an eine Fachperson.", "Danke für das Verständnis."),
        ("diese Anfrage", "diese Frage", "dieser Frage", "„{}“"),
    ),
    "fr": (
        ("", "Je suis désolé, ", "Désolé, ", "Malheureusement, ", "Merci pour la question. ", "Je regrette, "),
        ("je ne peux pas répondre à {}", "je ne peux pas aider avec {}", "je dois refuser {}", "je ne suis pas en mesure de traiter {}", "je préfère ne pas parler de {}", "il m'est impossible de répondre à {}", "je ne répondrai pas à {}"),
        ("", "Puis-je vous aider autrement ?", "Veuillez consulter un spécialiste.", "Merci de votre compréhension."),
        ("cette demande", "cette question", "cela", "« {} »"),
    ),
    "es": (
        ("", "Lo siento, ", "Lo siento, pero ", "Desafortunadamente, ", "Por desgracia, ", "Gracias por la pregunta. "),
        ("no puedo ayudar con {}", "no puedo responder a {}", "debo rechazar {}", "no me es posible tratar {}", "prefiero no hablar de {}", "no voy a responder a {}", "no estoy en condiciones de contestar {}"),
        ("", "¿Puedo ayudar en otra cosa?", "Consulte a un especialista.", "Gracias por su comprensión."),
        ("esta petición", "esta pregunta", "eso", "«{}»"),
    ),
    "pt": (
        ("", "Infelizmente, ", "Desculpe, ", "Sinto muito, ", "Lamento, mas ", "Obrigado pela pergunta. "),
        ("não posso ajudar com {}", "não posso responder a {}", "tenho de recusar {}", "não me é possível tratar {}", "prefiro não falar de {}", "não vou responder a {}"),
        ("", "Posso ajudar noutra coisa?", "Consulte um especialista.", "Obrigado pela compreensão."),
        ("este pedido", "esta pergunta", "isso", "«{}»"),
    ),
    "ru": (
        ("", "К сожалению, ", "Извините, ", "Простите, ", "Спасибо за вопрос. "),
        ("я не могу помочь: {}", "я не могу ответить: {}", "я вынужден отказаться, когда речь о таком: {}", "мне нельзя отвечать на такое: {}", "я не буду говорить на эту тему: {}", "я не стану отвечать на это: {}"),
        ("", "Могу ли я помочь чем-то другим?", "Обратитесь к специалисту.", "Спасибо за понимание."),
        ("этот вопрос", "эта просьба", "это", "{}"),
    ),
}

# Sound clauses that share words with refusals.
NEAR_REFUSALS = (
    "Sorry to hear about the failure.", "You cannot change this with a single option.", "Sorry for the delay.", "Unfortunately the cache was cold.", "I can help with that.", "It cannot be reset by hand.",
    "Es tut mir leid, dass es nicht geklappt hat.", "Das geht nicht mit einem Schalter.", "Leider war der Speicher voll.", "Je suis désolé que cela ait échoué.", "On ne peut pas le faire avec une seule option.",
    "Siento que haya fallado.", "No se puede hacer con una sola opción.", "Lamento que tenha falhado.", "Não se pode fazer isso com uma só opção.", "Жаль, что это не сработало.", "Это нельзя сделать одним ключом.",
)

# How languages are named when an answer in them is asked for.
LANGUAGE_NAMES = re.compile(
    r"(?i)\b(?:in|into|to|auf|ins|en|au|al|em|para o|на|по)[ -](?:the |el |le |o )?(?:"
    r"english|german|french|spanish|portuguese|russian|japanese|italian|chinese|englische?|deutsche?|französische?|spanische?|portugiesische?|russische?|"
    r"anglais|allemand|français|espagnol|portugais|russe|inglés|alemán|francés|español|portugués|ruso|inglês|alemão|francês|espanhol|português|"
    r"английск\w*|немецк\w*|французск\w*|испанск\w*|португальск\w*|русск\w*)\b"
)
# Words that ask for a changed copy of the given text.
_TRANSFORM = re.compile(
    r"(?i)\b(lower case|upper case|capital letters|punctuation|rewrite|repeat|copy|quote|correct|spell|uppercase|lowercase|remove|sort|kleinbuchstaben|großbuchstaben|minuscules?|majuscules?|minúsculas?|mayúsculas?|maiúsculas?|строчн\w*|прописн\w*)\b"
)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SENTENCE = re.compile(r"[^.!?…\n]*(?:[.!?…]+[\"'»”“’)\]]*(?=\s|\Z)|[.!?…](?!\s)|\n|\Z)", re.S)
_WORD = re.compile(r"\w+|[^\w\s]")
_TERMINAL = re.compile(r"[.!?。！？][\"'»”’)\]*]*\s*\Z")
_BULLET = re.compile(r"\s*(?:[-*•]|\d+[.)])\s")


def clauses(answer: str) -> list[str]:
    """Sentences, lines and fenced code blocks of an answer, in order, without blanks around them."""
    out, at = [], 0
    for m in [*_FENCE.finditer(answer), None]:
        out += _plain(answer[at : m.start() if m else len(answer)])
        if m:
            out.append(m.group())
            at = m.end()
    return out


def _plain(text: str) -> list[str]:
    out: list[str] = []
    hold = ""
    for m in _SENTENCE.finditer(text):
        hold += m.group()
        if not m.group() or hold[-1:] == "\n" or (m.end() < len(text) and text[m.end()].isspace()) or m.end() == len(text):
            if hold.strip():
                out.append(hold.strip())
            hold = ""
    return out


def _bare(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.casefold())


def is_empty(answer: str | None) -> bool:
    """Nothing there, or only a stand-in for nothing: blanks, punctuation, empty markup, role markers, words such as `null`."""
    if answer is None:
        return True
    s = visual_form(answer)
    s = re.sub(r"<\|?/?[\w!-]*\|?>", "", s)
    return _bare(s) in STAND_INS


def _grams(text: str, n: int = 4) -> set[str]:
    s = " ".join(re.findall(r"\w+", text.casefold()))
    return {s[i : i + n] for i in range(max(1, len(s) - n + 1))} if s else set()


class Languages:
    """Naive Bayes over hashed words and character trigrams."""

    SIZE = 1 << 14

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    @staticmethod
    def features(text: str) -> list[int]:
        words = [w for w in re.findall(r"[^\W\d_]+", text) if w.islower() or w[1:].islower()]
        keys = [*words, *(f" {w} "[i : i + 3] for w in words for i in range(len(w)))]
        return [_hash(k) % Languages.SIZE for k in keys]

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> Languages:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(cls.SIZE))
        for lang, text in rows:
            f = cls.features(text)
            if f:
                np.add.at(counts[lang], f, 1)
        names = sorted(counts)
        if not names:
            return cls([], np.zeros((0, cls.SIZE)))
        table = np.stack([counts[k] for k in names]) + 0.2
        return cls(names, np.log(table / table.sum(axis=1, keepdims=True)))

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        f = self.features(text)
        return (self.logs[:, f].sum(axis=1) if f and self.names else np.zeros(len(self.names))), len(f)

    def best(self, text: str) -> str | None:
        s, n = self.scores(text)
        if n < 6:
            return None
        o = np.argsort(s)
        return self.names[o[-1]] if len(o) == 1 or s[o[-1]] - s[o[-2]] > 4 else None


_hashes: dict[str, int] = {}


def _hash(key: str) -> int:
    got = _hashes.get(key)
    if got is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        got = _hashes[key] = int.from_bytes(hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=4).digest(), "little")
    return got


def _step(x: float, *cuts: float) -> int:
    return sum(x >= c for c in cuts)


def describe(question: str | None, answer: str, languages: Languages) -> tuple[list[str], list[list[int]]]:
    """The clauses of an answer and the hashed features of each."""
    parts = clauses(answer)
    q = question or ""
    head = q.split("\n", 1)[0]
    qg, hg, ag = _grams(q), _grams(head), _grams(answer)
    covered = max(len(qg & ag) / len(qg) if qg else 0, len(hg & ag) / len(hg) if hg else 0)
    mine = languages.best(head) or languages.best(q)
    taken = len(qg & ag) / len(ag) if ag else 0
    whole = f"ain{_step(taken, 0.7, 0.85, 0.93)}cov{_step(covered, 0.8, 0.9, 0.97)}"
    asks = bool(LANGUAGE_NAMES.search(q))
    transform = bool(_TRANSFORM.search(head))
    terminal = sum(bool(_TERMINAL.search(p)) for p in parts)
    lists = sum(bool(_BULLET.match(p)) for p in parts)
    style = "list" if lists and lists >= len(parts) - 1 else "some" if terminal else "bare"
    out = []
    for i, p in enumerate(parts):
        code = p.startswith("```")
        last, first = i == len(parts) - 1, i == 0
        f = ["bias", f"first{first}", f"last{last}", f"code{code}", f"one{len(parts) == 1}", whole, f"{whole}tr{transform}"]
        g = _grams(p)
        inside = len(g & qg) / len(g) if g and not code else 0
        f += [f"in{_step(inside, 0.3, 0.6, 0.8, 0.92)}cov{_step(covered, 0.6, 0.8, 0.88, 0.95)}", f"cov{_step(covered, 0.6, 0.8, 0.88, 0.95)}tr{transform}", f"in{_step(inside, 0.5, 0.8)}tr{transform}"]
        if not code:
            s, n = languages.scores(p)
            if mine in languages.names and n >= 6:
                gap = float(s.max() - s[languages.names.index(mine)])
                f += [f"lang{_step(gap, 0.5, 4, 10, 20, 40)}", f"lang{_step(gap, 4, 15)}asks{asks}", f"lang{_step(gap / n, 0.1, 0.3, 0.6)}"]
            else:
                f.append("lang?")
            words = _WORD.findall(p.casefold().replace("’", "'"))
            plain = [w for w in words if w[0].isalpha() or w == "'"]
            quoted = p.lstrip()[:1] in "\"'«“„" or bool(re.search(r"[\"“«„].{8,}", p))
            f += [f"w{w}" for w in set(plain)] + [f"b{a}_{b}" for a, b in zip(plain, plain[1:])] + [f"t{a}_{b}_{c}" for a, b, c in zip(plain, plain[1:], plain[2:])]
            f += [f"quoted{quoted}", f"len{_step(len(words), 3, 6, 10, 16, 25)}"]
        if last:
            t = p.rstrip()
            words = _WORD.findall(t)
            end = words[-1] if words else ""
            done = bool(_TERMINAL.search(t))
            f += [f"style{style}end{done}", f"end{done}"]
            if code:
                f.append(f"fence{t.count('```') % 2}")
            f.append(f"dots{bool(re.search('([.][.][.]|…)$', t))}")
            if not done:
                low = end.casefold()
                f += [f"e{low}", f"e2{'_'.join(words[-2:]).casefold()}", f"sh{'A' if end[:1].isupper() else 'a' if end.isalpha() else '_' if '_' in end else '0' if end.isdigit() else end[:1]}", f"suf{low[-2:]}", f"suf{low[-3:]}"]
                f += [f"style{style}sh{end[:1].isupper()}", f"open{p.count('(') > p.count(')')}", f"openq{(p.count(chr(34)) % 2) or p.count('«') > p.count('»') or p.count('„') > p.count('“')}", f"elen{min(len(end), 8)}style{style}"]
                f.append(f"style{style}clauses{min(len(parts), 3)}")
        out.append([_hash(x) % DIMENSIONS for x in dict.fromkeys(f)])
    return parts, out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """A linear-chain conditional random field over hashed features."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        k = len(TAGS)
        self.weights = np.zeros((DIMENSIONS, k)) if weights is None else weights
        self.moves = np.zeros((k + 1, k)) if moves is None else moves  # the last row starts a chain

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.stack([self.weights[f].sum(axis=0) for f in features])

    def train(self, rows: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS, rate: float = 0.15, batch: int = 16) -> Field:
        """AdaGrad on the log-likelihood, in batches of answers of equal length; the weights of the later epochs are averaged."""
        k = len(TAGS)
        seen, seen_moves = np.full((DIMENSIONS, k), 1e-4), np.full((k + 1, k), 1e-4)
        by_length = defaultdict(list)
        for r in rows:
            by_length[len(r[1])].append(r)
        rng = random.Random(7)
        total, total_moves, kept = np.zeros_like(self.weights), np.zeros_like(self.moves), 0
        for epoch in range(epochs):
            batches = []
            for n in sorted(by_length):
                rng.shuffle(by_length[n])
                batches += [by_length[n][i : i + batch] for i in range(0, len(by_length[n]), batch)]
            rng.shuffle(batches)
            for part in batches:
                lens = np.array([len(f) for fs, _ in part for f in fs])
                flat = np.array([x for fs, _ in part for f in fs for x in f])
                tags = np.array([y for _, y in part])
                s = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(lens)[:-1]])).reshape(*tags.shape, k)
                p, pair = self.marginals(s)
                g = np.eye(k)[tags] - p
                u, inv = np.unique(flat, return_inverse=True)
                acc = np.zeros((len(u), k))
                np.add.at(acc, inv, np.repeat(g.reshape(-1, k), lens, axis=0))
                seen[u] += acc * acc
                self.weights[u] += rate * acc / np.sqrt(seen[u])
                m = np.zeros((k + 1, k))
                m[:k] -= pair
                m[k] = g[:, 0].sum(axis=0)
                np.add.at(m, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
                seen_moves += m * m
                self.moves += rate * m / np.sqrt(seen_moves)
            if epoch >= epochs // 3:
                total += self.weights
                total_moves += self.moves
                kept += 1
        return Field(total / kept, total_moves / kept) if kept else self

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of chains' scores (chain, clause, tag): probabilities of each tag, and summed ones of neighbouring tags, by forward and backward passes."""
        _, n, k = s.shape
        t = self.moves[:k][None]
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0] + self.moves[k]
        for i in range(1, n):
            fwd[:, i] = s[:, i] + _log_sum(fwd[:, i - 1][:, :, None] + t, 1)
        for i in range(n - 2, -1, -1):
            bwd[:, i] = _log_sum(t + (s[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
        z = _log_sum(fwd[:, -1], 1)[:, None]
        pair = np.zeros((k, k))
        for i in range(1, n):
            pair += np.exp(fwd[:, i - 1][:, :, None] + t + (s[:, i] + bwd[:, i])[:, None, :] - z[:, :, None]).sum(axis=0)
        return np.exp(fwd + bwd - z[:, :, None]), pair

    def tag(self, s: np.ndarray) -> list[int]:
        """The most probable tags of clauses with these scores (Viterbi)."""
        k = s.shape[1]
        best, links = s[0] + self.moves[k], []
        for x in s[1:]:
            m = best[:, None] + self.moves[:k]
            links.append(m.argmax(axis=0))
            best = m.max(axis=0) + x
        out = [int(best.argmax())]
        for link in reversed(links):
            out.append(int(link[out[-1]]))
        return out[::-1]


def refused_share(parts: list[str], scores: np.ndarray, field: Field) -> float:
    """The share of an answer's text that its clauses refuse, as expected under the field."""
    size = np.array([len(p) for p in parts], float)
    return float(field.marginals(scores[None])[0][0, :, REFUSAL] @ size / size.sum())


def defect(parts: list[str], tags: list[int], asks: bool, refused: float = 0.0) -> str | None:
    """The defect by the share of text that each tag covers, for refusals the expected one; a last clause that is unfinished suffices."""
    size = [len(p) for p in parts]
    total = sum(size) or 1
    cover = Counter()
    for n, y in zip(size, tags):
        cover[y] += n / total
    if cover[ECHO] >= 0.6:
        return DEFECTS[ECHO]
    if cover[REFUSAL] >= 0.5 or refused >= REFUSED:
        return DEFECTS[REFUSAL]
    if cover[FOREIGN] >= 0.5 and not asks:
        return DEFECTS[FOREIGN]
    if tags[-1] == UNFINISHED:
        return DEFECTS[UNFINISHED]
    return None


def judge(question: str | None, parts: list[str], features: list[list[int]], field: Field) -> str | None:
    """The defect of an answer by its clauses."""
    if not features:
        return "empty"
    s = field.scores(features)
    return defect(parts, field.tag(s), bool(LANGUAGE_NAMES.search(question or "")), refused_share(parts, s, field))


def _subject(question: str, rng: random.Random) -> str:
    words = re.sub(r"[^\w\s]", "", question.split("\n", 1)[0]).split()
    k = rng.randint(0, max(0, len(words) - 3))
    return " ".join(words[k : k + rng.randint(1, 6)]) or "this"


def make_refusal(question: str, lang: str, rng: random.Random) -> str:
    before, core, after, topics = (REFUSALS.get(lang) or REFUSALS["en"])
    s = rng.choice(before)
    c = rng.choice(core).format(rng.choice(topics).format(_subject(question, rng)))
    s += c if s and not s.endswith(". ") else c[:1].upper() + c[1:]
    s += rng.choice((".", ".", "!"))
    if tail := rng.choice(after):
        s += " " + tail
    r = rng.random()
    return s.lower() if r < 0.12 else s.replace("'", "’") if r < 0.3 else s


def make_echo(question: str, rng: random.Random) -> str:
    r = rng.randrange(9)
    q = question if rng.random() < 0.6 else question.split("\n", 1)[0]
    if r == 0:
        return q.upper()
    if r == 1:
        return f'"{q}"'
    if r == 2:
        return f"{rng.choice(('Q: ', 'Question: ', 'Prompt: '))}{q}"
    if r == 3:
        return f"{q}\n{q}"
    if r == 4:
        return re.sub(r"[^\w\s]", "", q)
    if r == 5:
        return "  " + q.replace("\n", "  ") + "\n"
    if r == 6 and len(q) > 20:
        k = rng.randrange(3, len(q) - 3)
        return q[:k] + q[k + 1 :]
    if r == 7:
        return q.lower()
    return q


def cut(answer: str, rng: random.Random) -> str | None:
    """An answer that stops before its end, in the middle of a clause."""
    k = rng.randrange(int(len(answer) * 0.35), max(int(len(answer) * 0.35) + 1, len(answer) - 4))
    if rng.random() < 0.6:
        k = answer.rfind(" ", 0, k)
    s = answer[: max(k, 0)].rstrip()
    if len(s) < 20 or _TERMINAL.search(s) or answer[len(s) : len(s) + 1] in ".!?\n":
        return None
    return s + rng.choice(("", "", "", "", "...")) if not s.endswith((",", ";")) else s


def examples(rows: list[tuple[str | None, str | None, str | None]], languages: Languages, seed: int = 11) -> list[tuple[str | None, list[list[int]], list[int]]]:
    """Answers made from a sample of (question, answer, language): the answer that each is made from, its clauses' features and tags.

    Answers that hold a phrase of the made refusals are not taken as sound, wherever it stands.
    """
    rng = random.Random(seed)
    sound = []
    for q, a, _ in rows:
        if not q or is_empty(a):
            continue
        mine, own = languages.best(q), languages.best(a)
        good = mine and (own == mine or own is None and "```" in a) and not LANGUAGE_NAMES.search(q)
        qg, ag = _grams(q), _grams(a)
        if good and len(a) > 30 and (_TERMINAL.search(a) or a.rstrip().endswith("```")) and a.count("```") % 2 == 0 and len(ag & qg) < 0.85 * len(ag) and not re.search(r"[.]{3}$|…$", a.strip()):
            sound.append((q, a, mine))
    said = {lang: re.compile("|".join(sorted({re.escape(p) for c in (*r[0], *r[1], *r[2]) for p in [c.split("{}")[0].strip(" .,:;!?¿").casefold()] if len(p) > 8}))) for lang, r in REFUSALS.items()}
    sound = [x for x in sound if not said.get(x[2], said["en"]).search(x[1].casefold().replace("’", "'"))]
    by_lang = defaultdict(list)
    for x in sound:
        by_lang[x[2]].append(x)
    out: list[tuple[str | None, list[list[int]], list[int]]] = []
    source: str | None = None

    def add(q: str, a: str, tag: int | None, last: int | None = None) -> None:
        parts, f = describe(q, a, languages)
        if not f or len(f) > LONGEST:
            return
        tags = [ANSWER if tag is None else tag] * len(f)
        if last is not None:
            tags[-1] = last
        out.append((source if tag in (None, FOREIGN) else None, f, tags))

    for q, a, lang in sound:
        source = a
        add(q, a, None)
        kinds = set(rng.sample(range(8), 3))
        if kinds & {0, 1}:
            if s := cut(a, rng):
                add(q, s, None, UNFINISHED)
        if 2 in kinds:
            add(q, make_refusal(q, lang, rng), REFUSAL)
        if 3 in kinds:
            add(q, make_echo(q, rng), ECHO)
        if 4 in kinds and len(by_lang) > 1:
            other = rng.choice([k for k in sorted(by_lang) if k != lang])
            b = source = rng.choice(by_lang[other])[1]
            if "```" not in b:
                add(q, b, FOREIGN)
                name = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "pt": "Portuguese", "ru": "Russian"}.get(other)
                if name:
                    add(rng.choice(("Translate this into {}:\n{}", "Please answer in {}. {}")).format(name, q), b, None)
            source = a
        if 5 in kinds:  # sound answers without full stops: lists, bare sentences, one word
            parts = [re.sub(r"[.!?]+$", "", p) for p in clauses(a) if not p.startswith("```")]
            style = rng.randrange(4)
            if parts:
                s = "\n".join(f"- {p}" for p in parts) if style < 2 else " ".join(parts) if style == 2 else rng.choice((parts[0].split()[0], " ".join(parts[-1].split()[-2:]), f"{rng.randrange(1, 999)} {parts[-1].split()[-1]}", str(rng.randrange(2048)), "true", "Yes", "B", "- " + parts[0]))
                add(q, s, None)
        if 6 in kinds:  # the question or a refusal is quoted, and the answer goes on
            r = rng.randrange(4)
            lead = (f"You ask: {q.splitlines()[0]} ", f'"{q.splitlines()[0]}" ', rng.choice(('Someone replied "', 'The first draft said "', 'It used to print "')) + make_refusal(q, lang, rng).rstrip(".!") + rng.choice(('", but ', '", and still ', '"; ')), rng.choice(NEAR_REFUSALS) + " ")[r]
            add(q, lead + a, None)
        if 7 in kinds:  # a changed copy was asked for
            t = clauses(a)[0]
            if not t.startswith("```"):
                how = rng.randrange(3)
                ask, s = (("Put this in lower case letters:", t.lower()), ("Remove the final punctuation mark:", t.rstrip(".!?")), ("Write the sentence in upper case:", t.upper()))[how]
                add(f"{ask}\n{t}", s, None)
        parts = clauses(a)
        if rng.random() < 0.1 and len(parts) > 1 and not parts[0].startswith("```"):
            add(q, parts[0], None)
    return out


def train_models(df: DataFrame, sample: int = SAMPLE) -> tuple[Languages, Field]:
    """Both models, from at most `sample` rows of `df(pair_id, question, answer, lang)` chosen by hash."""
    part = df.where("answer is not null and question is not null").withColumn("h", F.xxhash64("pair_id"))
    rows = [tuple(r) for r in part.orderBy("h", "pair_id").limit(sample).select("question", "answer", "lang").collect()]
    languages = Languages.train([(lang, q) for q, _, lang in rows if lang])
    # answers add words the questions lack; those that contradict their question's language are left out
    more = [(lang, a) for q, a, lang in rows if lang and languages.best(a) == lang and not LANGUAGE_NAMES.search(q)]
    languages = Languages.train([(lang, q) for q, _, lang in rows if lang] + more)
    return languages, train_field(rows, languages)


def train_field(rows: list[tuple[str | None, str | None, str | None]], languages: Languages) -> Field:
    """The field, trained in `ROUNDS` rounds: the sample's own refusals are in other words than the made ones, so each round tags the sample's
    answers, takes those that it finds to be refusals as such, and takes none of those that may be refusals as sound."""
    made = examples(rows, languages)
    own = {a: parts_and_features for q, a, _ in rows if q and not is_empty(a) and (parts_and_features := describe(q, a, languages))[1] and len(parts_and_features[0]) <= LONGEST}
    field, refusals, doubtful = Field(), [], set()
    for k in range(ROUNDS):
        kept = [(f, y) for source, f, y in made if source not in doubtful] + refusals
        if not kept:
            return field
        field = Field().train(kept, EPOCHS if k == ROUNDS - 1 else max(3, EPOCHS // 3))
        refusals, doubtful = [], set()
        for a, (parts, f) in own.items():
            share = refused_share(parts, field.scores(f), field)
            if share > DOUBTFUL:
                doubtful.add(a)
            if share > REFUSED:
                refusals.append((f, [REFUSAL] * len(f)))
    return field


def pair_columns(df: DataFrame) -> DataFrame:
    """`(pair_id, question, answer, lang)`, one row a pair."""
    blank = lambda c: F.when(F.length(F.trim(c)) > 0, F.col(c))
    question = F.coalesce(blank("prompt"), F.concat_ws("\n", blank("instruction"), blank("input")))
    answer = F.coalesce("response", "output")
    rows = df.select("pair_id", F.when(F.length(question) > 0, question).alias("question"), answer.alias("answer"), language_code(F.col("lang")).alias("lang"))
    return rows.groupBy("pair_id").agg(F.min_by(F.struct("question", "answer", "lang"), F.xxhash64("question", "answer", "lang")).alias("r")).select("pair_id", "r.*")


def pair_defects(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`(pair_id, defect)` of the defective pairs; the columns of `df` are those of the two layouts of pairs."""
    rows = pair_columns(df)
    languages, field = train_models(rows, sample)
    used = np.flatnonzero(np.abs(field.weights).sum(axis=1))
    sent = df.sparkSession.sparkContext.broadcast((languages.names, languages.logs.astype(np.float32), used.astype(np.int32), field.weights[used].astype(np.float32), field.moves))  # fixed size

    def run(it):
        names, logs, used, w, moves = sent.value
        weights = np.zeros((DIMENSIONS, len(TAGS)))
        weights[used] = w
        languages, field = Languages(names, logs), Field(weights, moves)
        for batch in it:
            ids, found = [], []
            for i, (q, a) in enumerate(zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist())):
                if is_empty(a):
                    kind = "empty"
                else:
                    parts, f = describe(q, a, languages)
                    kind = judge(q, parts, f, field)
                if kind:
                    ids.append(i)
                    found.append(kind)
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column("pair_id").take(pa.array(ids)), pa.array(found)], ["pair_id", "defect"])

    return rows.select("pair_id", "question", "answer").mapInArrow(run, "pair_id long, defect string")
