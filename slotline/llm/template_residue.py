"""Mails that hold template residue, filler, an error page or a scripts-required notice instead of a message.

A mail's own lines are cut into segments. Three regularized linear classifiers over hashed n-grams,
segment length and page title decide per segment: whether it leaves a placeholder unfilled, whether
it is content at all (and not a greeting, name, disclaimer or contact line), and whether content is
filler or a notice (or a real sentence, perhaps about one). They are trained on weak labels, from
status codes and phrases, of a bounded sample of mails, and validated on mails of hosts that the
training did not see. Phrase lists give labels only; a mark is what the classifiers say.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.mail_text import own_text

DIMENSIONS = 1 << 15
TRAINING_MAILS = 6000  # bound of the labelled sample

#: Spellings of placeholders that a mail merge should have replaced.
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}|\$\{[^{}\n]{1,60}\}|\{\$[^{}\n]{1,60}\}|\*\|[^|\n]{1,60}\|\*|<%=?[^%\n]{1,60}%>|%%[^%\n]{1,60}%%|\[\[[^\]\n]{1,60}\]\]|@@[^@\n]{1,60}@@"
    r"|#[^\W\d][\w. -]{0,50}#|«\s?[^\W\d][\w. ]{1,50}»|<<[\w.]{1,40}(?: [\w.]{1,20}){0,2}>>|\{%[^%\n]{1,60}%\}|%\([^)\n]{1,60}\)s|(?<!\w)%s(?!\w)|\$[^\W\d][\w. ]{0,50}\$|(?<![\w%])%[^\W\d][\w.]{0,50}%"
    r"|\{[\w. ]{1,50}\}|\[(?:insert|tbc|tbd|todo|à compl|rellenar|bitte|uzup|wpisz|hier|ici|aquí|your|name)[^\]\n]{0,60}\]|\[object Object\]|\bundefined\b|\bnull(?: null)+\b|\bNaN\b|_{6,}|(?<!\w)__[^\W\d_][\w. ]{0,40}__(?!\w)|\?{4,}|\w*PLACEHOLDER\w*"
    r"|\bXX/XX/\w+|~[^\W\d][\w. ]{1,50}~|<[^\W\d][\w. -]{2,40}>|\[[^\W\d][\w. -]{1,40}\]|(?<![\w|])\|[^\W\d][\w.]{1,40}\||\^[^\W\d][\w. ]{1,40}\^|&&[^\W\d][\w. ]{1,40}&&|\((?:date|name|time|place|to be)[^)\n]{0,30}(?:filled in|completed|confirmed)\)|\bTODO\b",
    re.I,
)
#: Phrases by which a text talks about placeholders instead of leaving one unfilled.
ABOUT = re.compile(
    r"(?i)pars(?:er|ing)|render|format string|in the script|expanded by|in the draft|the tool|type .* in the letter|platzhalter|vorlage|szablon|s'arr|https?://|\broom\b|\bseat\b|sign on paper|template|plantilla|modèle|regex|\bINST\b|untouched|swaps? it|placeholder|stylesheet|%20|\bcolumn\b|attached sheet|\bemoticon"
)
#: Phrases of status pages, script notices and filler, in the archives' languages.
STATUS = re.compile(
    r"(?i)\b(?:error|erreur|fehler|błąd|エラー)[ :]*\(?[45]\d\d\b|\b[45]\d\d[ :–-]+(?:not found|bad|gone|forbidden|internal|service|gateway|too many|unauthorized|method|request)|access denied|permission to view|something went wrong|internal server error"
    r"|service (?:is )?(?:temporarily )?unavailable|can.?t be reached|took too long|too many requests|was rejected|session has (?:run out|expired)|traceback|most recent call|[a-z]+error:|nicht erreichbar|introuvable|no se pudo|planned maintenance|\"status\"|nie znaleziono|niedostępn|not found|見つかりません|connection (?:refused|reset|timed)|stack trace|exception in|^\s*at [\w.$]+\(|bad gateway|not exist on this server|web front|return to (?:the )?(?:home|start)"
)
SCRIPTS = re.compile(r"(?i)noscript|loading\.\.\.|(?:java\s?script|\bscripts?\b|skript\w*|スクリプト|\bjs\b).{0,80}(?:enabl|activ|aktiv|allow|block|switch|requir|need|benöt|włąc|有効|off\b|on\b|turn|without|unavailable)|(?:enabl|activ|aktiv|allow|block|requir|need|benöt|włąc|turn|without|does not run).{0,80}(?:java\s?script|\bscripts?\b|skript\w*|\bjs\b)")
FILLER = re.compile(r"(?i)lorem ipsum|\basdf|\bblah blah|\bx{3,} x+|dummy (?:copy|text)|sample text|(?:placeholder|filler) text|goes here|tekst zastępczy|będzie treść|texto de relleno|blindtext|fülltext|texte de remplissage|faux texte|\b(\w+)(?: \1){3,}|\bitem \w+ description|^tbd\b|ダミー|サンプル(?:テキスト|文)|このテキストは")
_LATIN = set("lorem ipsum dolor sit amet elit sed do ut et magna aliquam erat nulla massa vitae mauris nec eget tellus justo ornare porta semper finibus lacinia dapibus pellentesque vulputate rutrum felis quis ante tortor velit curabitur consectetur adipiscing eiusmod tempor".split())
#: Disclaimers and contact lines, which make a mail neither real nor junk.
NEUTRAL = re.compile(r"(?i)confidential|confidentiel|vertraulich|poufn|este correo es privado|meant for the person|got it by mistake|accepts no liability|irrtümlich|por error, bórrelo|do not print|機密|\b(?:tel|tél|telefon|電話)\b|^[-_=*\s]+$|unsubscribe")
_RULE = re.compile(r"^[-_=*~\s]+$")  # a drawn line
_SPLIT = re.compile(r"(?<=[.!?;])\s+(?=[^\Wa-z])|(?<=[。！？])")
_WORD = re.compile(r"\w+")


_CODE, _DIGITS = re.compile(r"(?<![\w.,-])[45]\d\d(?![\w,-])"), re.compile(r"\d+")


def collapse(segment: str) -> str:
    """Numbers replaced by marks: that of a status code, or 0."""
    return _DIGITS.sub("0", _CODE.sub("\u00a7", segment))


def mask(segment: str) -> str:
    """Lower case, numbers and what is shaped like a placeholder replaced by marks."""
    return PLACEHOLDER.sub(" phtok ", collapse(segment)).lower()


def segments(mail: str | None) -> list[str]:
    own = own_text(mail)
    out = [html.unescape(s).strip() for line in own.lines if not _RULE.match(line) for s in _SPLIT.split(line) if s and s.strip()]
    return ([f"title: {own.title}"] if own.title else []) + out


def features(masked: str) -> list[int]:
    """Hashed word uni- and bigrams, character trigrams, length and number of words of a masked segment."""
    words = _WORD.findall(masked)
    grams = [f"w {w}" for w in words] + [f"b {a} {b}" for a, b in zip(words, words[1:], strict=False)]
    grams += [f"c {g}" for g in {masked[i : i + 3] for i in range(max(0, len(masked) - 2))}]
    grams += [f"latin {int(6 * sum(w in _LATIN for w in words) / len(words))}"] if len(words) > 3 else []
    grams += [f"l {min(12, len(masked).bit_length())}", f"n {min(9, len(words))}"] + (["code"] if "\u00a7" in masked else []) + (["ph"] if "phtok" in masked else [])
    return sorted({zlib.crc32(g.encode()) % DIMENSIONS for g in grams})


def is_short(masked: str) -> bool:
    """Too short for a sentence: greetings, names, closings."""
    return len(_WORD.findall(masked)) <= 5 and not re.search(r"[぀-ヿ一-鿿]{8}", masked)


LABELS = {"residue": 0.2, "content": 0.5, "junk": 0.5}  # and the weight of the positive ones in training


def weak_labels(parts: list[str]) -> list[tuple[str, int, int, int | None]]:
    """(masked segment, residue, content, junk) of a mail's segments; junk is None where there is no content."""
    found = []
    for s in parts:
        m = mask(s)
        words = _WORD.findall(m)
        latin = len(words) > 3 and sum(w in _LATIN for w in words) >= 0.6 * len(words)
        hit = bool(latin or STATUS.search(s) or SCRIPTS.search(s) or FILLER.search(s))
        neutral = bool(NEUTRAL.search(s))
        found.append((s, m, hit, neutral, (hit or not is_short(m)) and not neutral))
    body = [hit for _, _, hit, _, content in found if content]
    junk = any(body) and (sum(body) >= 0.6 * len(body) or (len(body) <= 4 and 3 * sum(body) >= len(body)))
    return [(m, int("phtok" in m and not neutral and not ABOUT.search(s)), int(content), int(junk) if content else None) for s, m, _, neutral, content in found]


class Linear:
    """Logistic regression over hashed features with an L2 penalty, by gradient steps on the whole sample; the positive ones have the share ``positive`` of the weight."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[list[int]], labels: list[int], counts: list[float], positive: float = 0.5, penalty: float = 1e-6, steps: int = 500) -> Linear:
        w, bias = np.zeros(DIMENSIONS), 0.0
        if not rows or len(set(labels)) < 2:
            return cls(w, (1e3 if labels and labels[0] else -1e3))
        y = np.array(labels, float)
        lengths = np.array([len(r) for r in rows])
        at, of = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), lengths)
        value = (1 / np.sqrt(lengths))[of]
        seen = np.log1p(np.array(counts, float))
        weight = seen * np.where(y > 0, positive / max(seen[y > 0].sum(), 1e-9), (1 - positive) / max(seen[y == 0].sum(), 1e-9))
        square = np.full(DIMENSIONS, 1e-8)
        for _ in range(steps):  # AdaGrad
            p = 1 / (1 + np.exp(-(np.bincount(of, weights=w[at] * value, minlength=len(rows)) + bias)))
            r = (p - y) * weight
            g = np.bincount(at, weights=r[of] * value, minlength=DIMENSIONS) + penalty * w
            square += g * g
            w -= 0.3 * g / np.sqrt(square)
            bias -= 0.5 * r.sum()
        return cls(w, bias)

    def score(self, row: list[int]) -> float:
        z = self.weights[row].sum() / np.sqrt(len(row)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _sampled(documents: DataFrame, most: int) -> list[tuple]:
    """(host, masked segment, labels, mails) of about ``most`` mails (at most twice as many), those of least hash of their ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(str(h or ""), *x) for h, t in zip(f.host, f.text, strict=True) for x in weak_labels(segments(t))]
            yield pd.DataFrame(out, columns=["host", "segment", *LABELS]).astype({c: "Int64" for c in LABELS})

    fine = 1 << 40
    at = F.pmod(F.xxhash64("doc_id"), F.lit(fine))
    share = min(1.0, most / max(1, documents.count()))
    host = F.substring_index("sender", "@", -1)
    chosen = documents.select(at.alias("at"), host.alias("host"), "text").filter(F.col("at") < int(share * fine) + 1).orderBy("at", "text").limit(2 * most)
    spread = chosen.repartition(64)  # the limit leaves them in one task
    labelled = spread.select("host", "text").mapInPandas(run, "host string, segment string, " + ", ".join(f"{c} bigint" for c in LABELS))
    return [tuple(r) for r in labelled.groupBy("host", "segment", *LABELS).count().collect()]  # bounded by the sample


def _balanced(rows: list, label: int) -> tuple[list, list, list]:
    """Features, commonest label and surplus of votes of each distinct segment, in a fixed order."""
    votes: dict[str, int] = {}
    for r in rows:
        if r[label] is not None:
            votes[r[1]] = votes.get(r[1], 0) + (r[-1] if r[label] else -r[-1])
    seen = sorted(votes)
    return [features(s) for s in seen], [int(votes[s] > 0) for s in seen], [abs(votes[s]) for s in seen]


class ResidueDetector:
    """``fit`` on documents (doc_id, text, sender), then ``mark``."""

    def __init__(self, residue: Linear, content: Linear, junk: Linear, report: list[tuple]) -> None:
        self.residue, self.content, self.junk, self.report = residue, content, junk, report

    @classmethod
    def fit(cls, documents: DataFrame, most: int = TRAINING_MAILS) -> ResidueDetector:
        rows = _sampled(documents, most)
        unseen = [r for r in rows if zlib.crc32(r[0].encode()) % 5 == 0]
        seen = [r for r in rows if zlib.crc32(r[0].encode()) % 5]
        models, report = [], []
        for label, (name, positive) in enumerate(LABELS.items(), 2):
            train = seen if len({r[label] for r in seen if r[label] is not None}) > 1 else rows
            model = Linear.fit(*_balanced(train, label), positive)
            x, y, _ = _balanced(unseen, label)
            p = [model.score(r) > 0.5 for r in x]
            hit = sum(a and b for a, b in zip(p, y, strict=True))
            report.append((name, len(train), len(y), hit / max(1, sum(p)), hit / max(1, sum(y))))
            models.append(model)
        return cls(*models, report)

    def _judged(self, segment: str) -> tuple[float, bool, float]:
        """Residue score, whether it is content, and junk score; of the collapsed segment, so that equal ones are judged once."""
        f = features(mask(segment))
        return self.residue.score(f), self.content.score(f) > 0.5, self.junk.score(f)

    def kind_of(self, parts: list[str], known: dict[str, tuple[float, bool, float]]) -> tuple[str | None, float]:
        most, worst, real = 0.0, 0.0, 0
        for s in parts:
            key = collapse(s)  # all that a score depends on
            if key not in known:
                if len(known) > 200_000:
                    known.clear()
                known[key] = self._judged(key)
            r, content, j = known[key]
            most = max(most, r)
            if content and j > 0.5:
                worst = max(worst, j)
            elif content:
                real += 1
        kind = "placeholder" if most > 0.5 else "junk" if worst > 0.5 and not real else None
        return kind, max(most, worst if not real else 0.0)

    def mark(self, documents: DataFrame) -> DataFrame:
        """doc_id, marked, kind ('placeholder', 'junk' or NULL), score, for every row.

        A mail is marked if one of its own segments leaves a placeholder unfilled, or if it has junk
        segments and no real one. NULL, empty and blank texts are not marked; repeated rows are
        marked alike. Whole mails are read.
        """

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict[str, tuple[float, bool, float]] = {}
            for frame in frames:
                out = []
                for doc, text in zip(frame.doc_id, frame.text, strict=True):
                    kind, score = self.kind_of(segments(text), known)
                    out.append((doc, kind is not None, kind, score))
                yield pd.DataFrame(out, columns=["doc_id", "marked", "kind", "score"])

        return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, marked boolean, kind string, score double")


def clean_corpus(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents that are not marked."""
    return documents.join(marks.filter("marked").select("doc_id").distinct(), "doc_id", "left_anti")
