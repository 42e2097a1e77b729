"""Problem 10: left-over templates, filler, error pages and script notices.

Three character n-gram models tell filler, notices and natural prose apart. What
filler and notices look like is learnt from the corpus: windows (lines and
sentences) that make up much of several documents, counted over all of them. A
small grammar of filler and notices in eight languages starts the models where
the corpus has none; all other documents give the prose. Every count is over all
documents and their whole texts, added up by the tasks in tables of fixed size.

A document goes out by either of two rules: residue, in windows with a positive
likelihood ratio against prose, covers half of its letters or more; or its
running text holds an unfilled placeholder that isn't quoted. The second rule is
by form, since a placeholder amid ten thousand letters of prose covers nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import ngrams

#: Share of a document's letters that residue must cover.
COVERAGE = 0.5
#: Share of a document's letters from which a window dominates it, and documents it must dominate to be learnt.
DOMINANT, LEAST_DOCS = 0.2, 3
#: Of the documents with a learnt window, the share that it must dominate.
MOSTLY = 0.5
#: Share of a learnt window's long n-grams from which it is prose with another name in it, and the n-grams.
SEEN, LONG_GRAM = 0.9, 8
GRAM, BITS = 4, 18

# Filler, and parts of notices that are combined with each other in each language.
FILLER = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Insert your own words at this point.", "Dummy copy, to be replaced.", "To be announced.", "Content is coming.", "Fülltext, bitte ersetzen.", "Hier kommt noch Inhalt hin.", "Texte provisoire, à compléter.", "Contenido provisional, pendiente de completar.",
    "Временный текст, заменить.", "Описание будет добавлено.", "仮のテキストです。", "文章は準備中です。", "占位文字，待替换。", "内容待补充。", "임시 문구입니다.", "내용을 입력해 주세요.",
]
NOTICE_PARTS = [
    (
        ["This website", "Our application", "The document viewer", "This part of the site"],
        ["needs JavaScript; turn it on and refresh.", "does not run while scripts are blocked.", "uses cookies, which your browser rejects.", "is down at the moment, try once more in a while.", "failed with an unexpected error.", "is not open to you.", "could not be found.", "did not answer in time."],
    ),
    (
        ["", "Sorry! ", "Warning: "],
        ["you are not authorized here.", "permission to see this resource is missing.", "enable scripts in your browser settings and load the page again.", "the request was rejected because too many of them arrived.", "the server timed out, so retry later.", "log in again, as your session is over.", "cookies have to be allowed for this page.", "an internal exception occurred while reading a file, on line 1.", "the address you opened does not exist any more."],
    ),
    (["", "Site: "], ["Navigation | Sign in | Search", "Go to main content", "Return to the start page", "Previous « » Next", "Copyright, all rights reserved", "Menu | About | Contact"]),
    (["Diese Webseite", "Unsere Anwendung", "Der Dienst"], ["benötigt JavaScript, schalten Sie es ein.", "läuft nicht ohne Skripte und Cookies.", "ist gerade nicht erreichbar.", "wurde nicht gefunden.", "meldet einen internen Fehler.", "ist für Sie gesperrt."]),
    (["Ce site", "Notre application", "Le service"], ["a besoin de JavaScript, autorisez-le.", "ne marche pas sans scripts ni cookies.", "est momentanément inaccessible.", "n'a pas été trouvé.", "signale une erreur interne.", "vous est interdit."]),
    (["Este sitio", "Nuestra aplicación", "El servicio"], ["necesita JavaScript, permítalo.", "no funciona sin scripts ni cookies.", "está caído por ahora.", "no se ha encontrado.", "informa de un fallo interno.", "está prohibido para usted."]),
    (["Этот сайт", "Наше приложение", "Сервис"], ["требует JavaScript, разрешите его.", "не работает без скриптов и cookie.", "сейчас недоступен.", "не найден.", "сообщает о внутренней ошибке.", "закрыт для вас."]),
    (["このサイトは", "アプリは", "サービスは"], ["JavaScriptが必要です。", "スクリプトとクッキーなしでは動きません。", "現在ご利用いただけません。", "見つかりませんでした。", "内部エラーを返しました。", "閲覧を許可されていません。"]),
    (["本网站", "应用程序", "服务"], ["需要JavaScript。", "没有脚本和Cookie无法运行。", "目前不可用。", "未找到。", "发生内部错误。", "禁止您访问。"]),
    (["이 사이트는", "애플리케이션은", "서비스는"], ["자바스크립트가 필요합니다.", "스크립트와 쿠키 없이는 작동하지 않습니다.", "현재 이용할 수 없습니다.", "찾을 수 없습니다.", "내부 오류가 났습니다.", "접근이 금지되었습니다."]),
]
NOTICES = [f"{subject} {rest}".strip() for subjects, rests in NOTICE_PARTS for subject in subjects for rest in rests] + [f"{lead}{x.value} {x.phrase}" for x in HTTPStatus if x.value >= 400 for lead in ("", "HTTP/1.1 ", "Error ")]
# The forms of an unfilled placeholder.
PLACEHOLDERS = re.compile(
    r"\{\{\s*[\w.]+\s*\}\}|\$\{\s*[\w.]+\s*\}|<%=?\s*[\w.]+\s*%>|\{%\s*[\w.]+\s*%\}|\[\[\s*[\w.]+\s*\]\]|@@\w+?@@|__[A-Z][A-Z_]*?__|%[A-Z][A-Z_]+%"
    r"|\[(?:INSERT|Insert|insert|YOUR|Your|your) [^\[\]\n]{1,40}\]|\((?:your|insert|YOUR|INSERT) [^()\n]{1,30} here\)|(?<!\{)\{[a-z_]*\d*\}(?![}-])(?<!\{\})|%\d\$[sd]"
    r"|<(?!(?:a|b|i|u|p|br|hr|em|li|ul|ol|td|tr|th|div|span|img|code|pre|table|strong|body|html|head|sub|sup)>)[a-z][a-z_]*>"
)
_QUOTED = re.compile(r"`[^`\n]*`|(?<=[\"“„«「])[^\w\s]{0,2}[{$<%\[@_(][^\"”“»」\n]{1,40}(?=[\"”“»」])")
_MARK = re.compile(r"[{}$<%\[@]|__|\((?:your|insert)", re.I)
_BOUNDS = np.zeros(0x10000, dtype=bool)
_BOUNDS[[ord(c) for c in "\n.!?。！？"]] = True
_CUT = re.compile(r"[\n.!?。！？]+")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_VARIES = re.compile(r"[\d/]")
_VARIABLE = re.compile(r"\b[0-9a-f]*\d[0-9a-f]*\b|/\S*")


def has_placeholder(text: str) -> bool:
    """Whether the running text holds an unfilled placeholder outside quotes."""
    return bool(_MARK.search(text) and PLACEHOLDERS.search(_QUOTED.sub(" ", text)))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, each with a line end and every digit as a nought, and the length of each."""
    codes, sizes = ngrams.code_points([t.lower() + "\n" for t in texts])
    return np.where((codes > 0x30) & (codes < 0x3A), np.uint32(0x30), codes), sizes


def _counts(texts: list[str]) -> np.ndarray:
    """Counts of the hashed n-grams of some texts."""
    codes, _ = _codes(texts)
    return np.bincount(ngrams.hashed(codes, GRAM, BITS), minlength=1 << BITS)


class ResidueModel:
    """Log-likelihood tables of filler, notices and prose over hashed character n-grams."""

    def __init__(self, filler: np.ndarray, notices: np.ndarray, prose: np.ndarray):
        base = ngrams.log_counts(prose)
        self.ratio = np.stack([ngrams.log_counts(filler) - base, ngrams.log_counts(notices) - base])

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: the text it belongs to, letters, and the ratios of filler and of notices to prose."""
        return self._windows(texts)[:4]

    def _windows(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The windows, the hash of the n-gram at each place, and the places of each text."""
        codes, sizes = _codes(texts)
        h = ngrams.hashed(codes, GRAM, BITS)
        bound = _BOUNDS[np.minimum(codes, 0xFFFF)]
        end = np.flatnonzero(bound) + 1
        size = np.diff(np.concatenate(([0], end)))
        owner = np.searchsorted(np.cumsum(sizes), end, side="left")
        letter = (codes > 0x40) & (codes != 0x60) | (codes >= 0x30) & (codes < 0x3A)
        return owner, ngrams.segment_sums(letter, size), ngrams.segment_sums(self.ratio[0][h], size), ngrams.segment_sums(self.ratio[1][h], size), h, sizes

    def classes(self, texts: list[str]) -> np.ndarray:
        """Counts of the n-grams of the texts that are prose, filler and notices, one after the other."""
        owner, letters, f, n, h, sizes = self._windows(texts)
        total = np.maximum(np.bincount(owner, weights=letters, minlength=len(texts)), 1)
        a, b = (np.bincount(owner, weights=letters * hit, minlength=len(texts)) / total for hit in ((f > 0) & (f >= n), (n > 0) & (n > f)))
        kind = np.where(a + b < COVERAGE, 0, np.where(a >= b, 1, 2))
        return np.bincount(np.repeat(kind << BITS, sizes) + h, minlength=3 << BITS)

    def coverage(self, texts: list[str]) -> np.ndarray:
        """Share of each text's letters in windows that are residue."""
        owner, letters, filler, notice = self.windows(texts)
        bad = np.maximum(filler, notice) > 0
        total = np.bincount(owner, weights=letters, minlength=len(texts))
        return np.bincount(owner, weights=letters * bad, minlength=len(texts)) / np.maximum(total, 1)


def _forms(text: str) -> list[str]:
    return [" ".join((_VARIABLE.sub("0", w) if _VARIES.search(w) else w).split()) for w in _CUT.split(text.lower())]


def _shares(text: str) -> dict[str, float]:
    """Share of a text's letters of each of its windows; numbers, codes and paths count as one sign."""
    out: Counter[str] = Counter()
    for form in _forms(text):
        joined = _NO_LETTERS.sub("", form)
        n = len(joined) if joined.isalpha() else sum(map(str.isalpha, joined))
        if n >= 3:
            out[form] += n
    total = sum(out.values())
    return {w: n / total for w, n in out.items()}


def _window_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each window, the window itself where it dominates a document, and the documents it stands in and dominates."""
    for b in batches:
        known: Counter[str] = Counter()
        led: Counter[str] = Counter()
        for t in b.column(0).to_pylist():
            shares = _shares(t)
            known.update(shares.keys())
            led.update(w for w, share in shares.items() if share >= DOMINANT)
        key = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in known), dtype=np.int64)
        columns = [pa.array(key), pa.array([w if w in led else None for w in known], pa.string()), pa.array(list(known.values()), pa.int64()), pa.array([led.get(w, 0) for w in known], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "window", "known", "led"])


def dominant_windows(df: DataFrame, text_col: str = "text", least: int = LEAST_DOCS) -> list[str]:
    """The windows that dominate ``least`` documents or more, and ``MOSTLY`` of those they stand in, counted over all documents.

    A window that stands amid other text more often than as the better part of a document is no residue.
    """
    counts = df.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(_window_counts, "key long, window string, known long, led long")
    counts = counts.groupBy("key").agg(F.max("window").alias("window"), F.sum("known").alias("known"), F.sum("led").alias("led"))
    return sorted(r[0] for r in counts.where((F.col("led") >= least) & (F.col("led") >= MOSTLY * F.col("known"))).select("window").collect())


def _learnt_model(summed: Callable[[Callable[[list[str]], np.ndarray], int], np.ndarray], learnt: list[str]) -> ResidueModel:
    """Models from the grammar, from what the corpus repeats, and from all documents, in two rounds.

    ``summed`` adds up the counts that a step makes of the texts. A learnt window
    whose long n-grams other documents have is no residue but prose with another
    name in it.
    """
    grams = [ngrams.long_hashes(ngrams.code_points([w])[0], LONG_GRAM) for w in learnt]
    wanted = np.unique(np.concatenate([*grams, np.zeros(1, np.uint64)]))
    hint = np.zeros(1 << 20, dtype=bool)
    hint[wanted >> np.uint64(44)] = True
    known = frozenset(learnt)

    def first(texts: list[str]) -> np.ndarray:
        """Counts of the n-grams of texts that learnt windows don't cover, and of the wanted long ones of texts that none dominates."""
        texts = [t for t in texts if t.strip()]
        shares = [{} if known.isdisjoint(_forms(t)) else {w: x for w, x in _shares(t).items() if w in known} for t in texts]
        codes, sizes = _codes(texts)
        bare = np.repeat(np.array([sum(own.values()) < COVERAGE for own in shares], dtype=bool), sizes)
        free = np.repeat(np.array([max(own.values(), default=0) < DOMINANT for own in shares], dtype=bool), sizes)
        h = ngrams.long_hashes(codes[free], LONG_GRAM)
        h = h[hint[h >> np.uint64(44)]]
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        return np.concatenate((np.bincount(ngrams.hashed(codes, GRAM, BITS)[bare], minlength=1 << BITS), np.bincount(at[wanted[at] == h], minlength=len(wanted))))

    told = summed(first, (1 << BITS) + len(wanted))
    prose, seen = told[: 1 << BITS], told[1 << BITS :] > 0
    if not prose.any():
        prose = summed(lambda texts: _counts([t for t in texts if t.strip()]), 1 << BITS)
    windows = [f"{w}\n{w}." for w, h in zip(learnt, grams) if not len(h) or seen[np.searchsorted(wanted, h)].mean() < SEEN]
    seeds = [_counts(FILLER), _counts(NOTICES)]
    model = ResidueModel(*seeds, prose)
    if windows:
        owner, _, f, n = model.windows(windows)
        closer = np.bincount(owner, weights=f - n, minlength=len(windows)) > 0
        for kind, own in enumerate((closer, ~closer)):
            seeds[kind] = seeds[kind] + _counts([w for w, x in zip(windows, own) if x])
        model = ResidueModel(*seeds, prose)
    for _ in range(2):
        step = model
        told = summed(lambda texts: step.classes([t for t in texts if t.strip()]), 3 << BITS).reshape(3, -1)
        if not told.any():
            break
        model = ResidueModel(seeds[0] + told[1], seeds[1] + told[2], told[0] if told[0].any() else told.sum(0))
    return model


def fit(texts: list[str], learnt: list[str] = ()) -> ResidueModel:
    """The models of some texts in memory."""
    held = [t for t in texts if t]
    return _learnt_model(lambda step, _: step(held), learnt)


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``(id_col, coverage, placeholder)`` of every document, which the caller filters by ``is_residue``.

    Null, empty and blank texts aren't residue.
    """
    texts = df.select(text_col).where(F.col(text_col).isNotNull())
    model = _learnt_model(lambda step, size: ngrams.summed(texts, step, size), dominant_windows(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                share = model.coverage(texts)
                marks = [has_placeholder(t) for t in texts]
                out = [bool((c >= coverage or m) and t.strip()) for c, m, t in zip(share, marks, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(share), pa.array(marks), pa.array(out)], names=["_id", "coverage", "placeholder", "is_residue"])

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, coverage double, placeholder boolean, is_residue boolean").withColumnRenamed("_id", id_col)
