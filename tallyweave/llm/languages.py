"""Problem 3: the languages of texts that lack a label or bear a wrong one.

Rank-order profiles: the n-grams (1 to 3 characters) of each sentence are ranked
by frequency and compared with the ranked profile of every language by
out-of-place distance; the nearest language wins, and the distance to the next
one gives the confidence. Ideographs count as one class, so kana and the
alternation of scripts tell Japanese from Chinese. All sentences of a batch are
ranked together with array operations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .spans import enclosed

#: n-grams in a language's profile, and the distance of one that isn't in it.
PROFILE = 800
#: Letters from which a sentence counts.
LEAST_LETTERS = 25
#: Confidence under which a sentence follows its surroundings.
UNSURE = 0.06
#: Share of a sentence's n-grams that the nearest profile must know; strings without words know fewer.
LEAST_KNOWN = 0.25

# Text the profiles are fitted on.
SAMPLES = {
    "en": """The board of directors is pleased to present the annual report of the company for the year ended. The results of the group were affected by higher costs, which were partly offset by
lower interest rates and by new contracts that had been signed before the end of the reporting period. Management believes that there is no reason to change the policy, and it will continue to
review its exposure. During the first quarter, the team moved to another office, while the number of people who were employed there remained the same. As set out in the notes, revenue increased
because of stronger demand from customers, although this was not enough to make up for the loss of one of the largest accounts. The committee has decided that a dividend should be paid to the
shareholders whose names are on the register. According to the auditors, these statements give a true and fair view of what was earned and spent. Under the terms of the agreement, neither party
may sell their stake without the other's consent. Compared with the previous year, the share of the segment in total income fell, reflecting fewer working days and a change in the product mix.
We do not expect any of those claims to have a material effect. They asked for longer settlement windows. Training covered every branch. Excluding one-off items, assets under management rose.
Across all branches, the group appointed an independent adviser to assess its operations, and the regulator completed a routine inspection without finding material errors. Profit after tax rose to
a new high, against a loss a year earlier, and net cash from operations narrowed because of longer collection periods. Greenhouse gas emissions declined to less than half of what they had been. Claims
against the company over services sold to investors are at an early stage; the company intends to renegotiate its supplier terms and to replace the settlement system next year. Headcount contracted,
while commission receipts, investment income and client mandates dropped or climbed depending on trading volumes. A provision was set aside for the division, despite unfavourable fair value movements.
Capital commitments for research projects amounted to more than expected. Owners should ask whether these figures are still useful, how they were made up, and which of them could be wrong. It is not
possible to say when the work will be finished, but our people have done everything they can, and most of the money has already been spent. Directors reviewed total liabilities together with the
forecast and debated the strategy at each of their meetings. Nothing else happened that would need to be mentioned here. The weighted cost of funding fell, as did the number of active clients.""",
    "fr": """Le conseil d'administration a le plaisir de vous présenter le rapport annuel de la société pour l'exercice clos. Les résultats du groupe ont été affectés par la hausse des coûts, qui a été en
partie compensée par la baisse des taux d'intérêt et par de nouveaux contrats conclus avant la fin de la période. La direction estime qu'il n'y a pas lieu de modifier cette politique et elle
continuera d'examiner ses engagements. Au cours du premier trimestre, l'équipe s'est installée dans un autre bureau, tandis que le nombre de personnes qui y travaillent est resté le même. Comme
indiqué dans les notes, le chiffre d'affaires a augmenté en raison d'une demande plus forte des clients, bien que cela n'ait pas suffi à compenser la perte de l'un des plus grands comptes. Le
comité a décidé qu'un dividende serait versé aux actionnaires dont les noms figurent au registre. Selon les commissaires aux comptes, ces états donnent une image fidèle de ce qui a été gagné et
dépensé. Par rapport à l'année précédente, la part de la branche dans le produit total a reculé, ce qui reflète la révision des tarifs ainsi que la cession de deux filiales. Nous ne pensons pas
que ces réclamations puissent avoir une incidence significative. Hors éléments exceptionnels, les capitaux propres se sont élevés à plusieurs millions d'euros malgré une météo plus douce.
Dans toutes les agences, le groupe a nommé un conseiller indépendant chargé d'évaluer ses activités, et l'autorité a achevé une inspection de routine sans relever d'erreur importante. Le résultat net a
atteint un nouveau sommet, contre une perte un an plus tôt, et la trésorerie s'est contractée du fait de délais d'encaissement plus longs. Les émissions sont tombées à moins de la moitié de ce qu'elles
étaient. Les demandes formées contre la société au sujet de services vendus aux clients en sont à leurs débuts ; la société prévoit de renégocier les conditions de ses fournisseurs et de remplacer le
système de règlement l'an prochain. L'effectif a diminué, tandis que les commissions perçues ont progressé selon les volumes. Une provision a été constituée pour la branche. Les propriétaires devraient
se demander si ces chiffres sont encore utiles, comment ils ont été établis et lesquels pourraient être faux. Il n'est pas possible de dire quand les travaux seront terminés, mais nos équipes ont fait tout
ce qu'elles pouvaient. Les administrateurs ont examiné le total du passif avec les prévisions et ont débattu de la stratégie à chacune de leurs réunions. Rien d'autre ne s'est produit.""",
    "de": """Der Vorstand freut sich, den Geschäftsbericht der Gesellschaft für das abgelaufene Jahr vorzulegen. Die Ergebnisse des Konzerns wurden durch höhere Kosten belastet, die teilweise durch
niedrigere Zinsen und durch neue Verträge ausgeglichen wurden, die vor dem Ende des Berichtszeitraums abgeschlossen worden waren. Die Leitung ist der Ansicht, dass es keinen Grund gibt, diese
Politik zu ändern, und wird ihre Risiken weiterhin prüfen. Im ersten Quartal zog die Abteilung in ein anderes Büro um, während die Zahl der dort beschäftigten Personen gleich blieb. Wie im Anhang
dargestellt, stieg der Umsatz wegen der stärkeren Nachfrage der Kunden, obwohl dies nicht ausreichte, um den Verlust eines der größten Aufträge auszugleichen. Der Ausschuss hat beschlossen, dass
eine Dividende an die Aktionäre gezahlt werden soll, deren Namen im Register stehen. Nach Auffassung der Prüfer vermitteln diese Abschlüsse ein Bild, das den tatsächlichen Verhältnissen
entspricht. Gegenüber dem Vorjahr verringerte sich der Anteil des Bereichs an den gesamten Erträgen, was ungünstige Wechselkurse widerspiegelt. Wir erwarten nicht, dass sich diese Ansprüche
wesentlich auswirken. Ohne Sondereffekte belief sich die Position auf mehrere Millionen Euro. Der Vorstand beabsichtigt, nicht notwendige Ausgaben zu verschieben und Beteiligungen zu verkaufen.
In allen Niederlassungen bestellte der Konzern einen unabhängigen Berater, der die Geschäfte bewerten soll, und die Aufsicht schloss eine übliche Prüfung ab, ohne wesentliche Fehler zu finden. Der
Jahresüberschuss stieg auf einen neuen Höchststand nach einem Verlust im Jahr zuvor, und der Mittelzufluss ging wegen längerer Zahlungsziele zurück. Die Emissionen sanken auf weniger als die Hälfte. Die
Ansprüche gegen die Gesellschaft wegen verkaufter Dienstleistungen stehen noch am Anfang; die Gesellschaft beabsichtigt, die Bedingungen der Lieferanten neu zu verhandeln und das Abwicklungssystem im
nächsten Jahr zu ersetzen. Die Zahl der Beschäftigten nahm ab, während die Provisionserträge je nach Umfang des Handels zunahmen. Für den Bereich wurde eine Rückstellung gebildet. Man sollte fragen, ob
diese Zahlen noch nützlich sind, wie sie zustande kamen und welche davon falsch sein könnten. Es lässt sich nicht sagen, wann die Arbeiten fertig werden, aber unsere Leute haben alles getan, was sie
konnten. Die Mitglieder berieten bei jeder ihrer Sitzungen über die Strategie und die Schätzung. Sonst ist nichts geschehen, was hier erwähnt werden müsste.""",
    "es": """El consejo de administración se complace en presentar el informe anual de la sociedad correspondiente al ejercicio cerrado. Los resultados del grupo se vieron afectados por el aumento de los
costes, que fue compensado en parte por la bajada de los tipos de interés y por los nuevos contratos que se habían firmado antes del final del periodo. La dirección considera que no hay motivo para
cambiar esta política y seguirá revisando su exposición. Durante el primer trimestre, el equipo se trasladó a otra oficina, mientras que el número de personas que trabajan allí siguió siendo el
mismo. Según se indica en las notas, los ingresos crecieron debido a una mayor demanda de los clientes, aunque esto no bastó para compensar la pérdida de una de las cuentas más grandes. El comité
ha decidido que se pague un dividendo a los accionistas cuyos nombres figuran en el registro. En opinión de los auditores, estos estados muestran la imagen fiel de lo que se ha ganado y gastado.
En comparación con el año anterior, la participación de la división en el total de la partida retrocedió, lo que refleja la evolución del tipo de cambio. No esperamos que estas reclamaciones tengan
un efecto importante. Al cierre del periodo, los compromisos ascendieron a varios millones de euros, pese a plazos de cobro más largos. Sin partidas extraordinarias, el gasto se redujo.
En todas las sucursales, el grupo nombró a un asesor independiente para evaluar sus operaciones, y el supervisor concluyó una inspección rutinaria sin encontrar errores importantes. El beneficio neto
alcanzó un nuevo máximo, frente a una pérdida un año antes, y la tesorería se redujo debido a plazos de cobro más largos. Las emisiones bajaron a menos de la mitad de lo que habían sido. Las demandas
contra la sociedad por servicios vendidos a los clientes se encuentran en una fase inicial; la sociedad prevé renegociar las condiciones de sus proveedores y sustituir el sistema de liquidación el próximo
año. La plantilla disminuyó, mientras que las comisiones percibidas crecieron según los volúmenes. Se dotó una provisión para la división. Los propietarios deberían preguntarse si estas cifras todavía
son útiles, cómo se hicieron y cuáles de ellas podrían estar equivocadas. No es posible decir cuándo terminarán los trabajos, pero nuestra gente ha hecho todo lo que ha podido. Los consejeros revisaron el
total del pasivo junto con las previsiones y debatieron la estrategia en cada una de sus reuniones. No ocurrió nada más que deba mencionarse aquí.""",
    "zh": """董事会欣然提呈本公司截至本年度末止年度的年度报告。集团业绩受到成本上升的影响，部分被利率下降以及报告期末之前签订的新合同所抵销。管理层认为没有理由改变这一政策，并将继续审视其风险敞口。第一季度，该团队迁入另一处办公室，
而在那里工作的人数保持不变。如附注所述，由于客户需求增强，营业收入有所增长，尽管这不足以弥补失去最大客户之一的损失。委员会决定向名列股东名册的股东派发股息。审计师认为，这些报表真实而公允地反映了所赚取和所花费的金额。
與去年同期比較，本集團的溢利有所減少，主要由於匯率變動，惟部分被成交量上升所抵銷。我们预计这些索赔不会产生重大影响。剔除一次性因素后，所管理的资产有所上升，达到数亿元，与上年披露的指引基本一致。""",
    "ja": """取締役会は当社の当連結会計年度の年次報告書をここに提出いたします。当社グループの業績は費用の増加による影響を受けましたが、金利の低下と、期末までに締結した新しい契約により一部相殺されました。経営陣はこの方針を変更する
理由はないと考えており、引き続きリスクを見直してまいります。第１四半期において、チームは別のオフィスに移転しましたが、そこで働く人の数は変わりませんでした。注記に記載のとおり、お客様からの需要が強まったため売上高は増加しましたが、最大の
取引先の一つを失ったことを補うには至りませんでした。委員会は株主名簿に記載された株主に対して配当を支払うことを決定しました。監査人によれば、これらの計算書類は適正に表示されています。前年同期と比較して、セグメントの占める割合は低下しており、
これは主に為替の変動によるものです。これらの請求が重要な影響を及ぼすとは考えていません。一時的な要因を除くと、残高は数百万円に達しました。サービスやデータセンターの売上もまた同じでした。""",
}
LANGUAGES = tuple(SAMPLES)

# Spellings of the languages' labels; anything else names none.
LABELS = {
    "en": "en eng english anglais englisch inglés ingles 英文 英语 英語",
    "fr": "fr fra fre french français francais französisch francés frances 法文 法语 法語 フランス語",
    "de": "de deu ger german deutsch allemand alemán aleman 德文 德语 德語 ドイツ語",
    "es": "es spa esp spanish español espanol spanisch espagnol castellano 西班牙文 西班牙语 西班牙語 スペイン語",
    "zh": "zh zho chi cn cmn chinese mandarin chinois chinesisch chino hans hant zhs zht 中文 汉语 漢語 华语 简体中文 繁體中文 繁体中文 简体 繁體 中国語 中國語",
    "ja": "ja jpn jp japanese japonais japanisch japonés japones 日本語 日文 日语 日語",
}


_PARTS = r"[\s_\-/,;()（）.:]+"


def label_language(label: str | None) -> str | None:
    """The language a label names: by its first part, without regard to case, region or script."""
    parts = [p for p in re.split(_PARTS, (label or "").lower()) if p]
    table = {s: lang for lang, text in LABELS.items() for s in text.split()}
    return next((table[p] for p in parts[:1] if p in table), None)


# --- symbols ----------------------------------------------------------------------------------------------------

_ACCENTS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
_IDEOGRAPH = 255


@cache
def _symbols() -> np.ndarray:
    """Symbol (0 none, 1-26 Latin, then accents, kana, one class of ideographs) of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = table[0xFF41 + i] = table[0xFF21 + i] = i + 1
    for i, c in enumerate(_ACCENTS):
        table[ord(c)] = 30 + i
        if len(c.upper()) == 1:
            table[ord(c.upper())] = 30 + i
    table[0x3041:0x3097] = np.arange(0x3097 - 0x3041) + 64
    table[0x30A1:0x30FB] = np.arange(0x30FB - 0x30A1) + 152
    table[0x30FC] = 245
    table[0xFF66:0xFF9E] = 246
    for begin, end in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        table[begin:end] = _IDEOGRAPH
    table[0x3005] = _IDEOGRAPH
    return table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _all_grams(symbols: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of 1, 2 and 3 symbols; spaces count at an edge only."""
    s = symbols.astype(np.uint32)
    one = s[s > 0]
    two = s[:-1] << 8 | s[1:]
    two = two[(s[:-1] > 0) | (s[1:] > 0)]
    three = s[:-2] << 16 | s[1:-1] << 8 | s[2:]
    three = three[(s[1:-1] > 0)]
    return np.concatenate([one | 1 << 24, two | 1 << 25, three])


@cache
def profiles() -> tuple[np.ndarray, ...]:
    """(index of each 1-, 2-, 3-gram among the n-grams of all profiles, ranks [n-gram, language], weight of each n-gram, whether it has 3)."""
    ranked = {}
    for lang, text in SAMPLES.items():
        text = re.sub(r"\s+", " " if lang in ("en", "fr", "de", "es") else "", text)
        counted = Counter(_all_grams(np.r_[0, _symbols()[_codes(text)], 0].astype(np.uint8)).tolist())
        ranked[lang] = [g for g, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]]
    every = sorted({g for grams in ranked.values() for g in grams})
    position = {g: i + 1 for i, g in enumerate(every)}
    ranks = np.full((len(every) + 1, len(LANGUAGES)), -1, dtype=np.int32)
    for column, lang in enumerate(LANGUAGES):
        for rank, g in enumerate(ranked[lang]):
            ranks[position[g], column] = rank
    ones, twos, threes = np.zeros(1 << 8, dtype=np.int16), np.zeros(1 << 16, dtype=np.int16), np.zeros(1 << 24, dtype=np.int16)
    weights = np.ones(len(every) + 1)
    for g, i in position.items():
        table, code = (ones, g & 0xFF) if g >> 24 & 1 else (twos, g & 0xFFFF) if g >> 25 & 1 else (threes, g)
        table[code] = i
        if any((g >> shift) & 0xFF == _IDEOGRAPH for shift in (0, 8, 16)):
            weights[i] = 2.0  # an ideograph says as much as two letters
        elif all((g >> shift) & 0xFF < 64 for shift in (0, 8, 16)):
            weights[i] = 0.1 if g >> 24 & 1 else 0.5 if g >> 25 & 1 else 1.0  # single Latin letters say little
    threes_of = np.zeros(len(every) + 1, dtype=bool)
    threes_of[threes[threes > 0]] = True
    return ones, twos, threes, ranks, weights, threes_of


# --- sentences --------------------------------------------------------------------------------------------------

_FENCED = re.compile(r"^[ \t]*```[^\n]*\n.*?(?:^[ \t]*```[ \t]*$|\Z)", re.M | re.S)
_NOT_PROSE = re.compile(
    r"^[ \t>]*(?:#|\||\{\||!|={2,}|```)[^\n]*$|^[ \t]*(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|def |for \w+ in |return |import |assert |[\w\[\]]+ \+?= |\{\"|\w+\()[^\n]*$"
    r"|\\(?:sub)*section\*?\{[^{}\n]*\}|\$[^$\n\\]*\\[^$\n]*\$|\\[A-Za-z]+|</?[A-Za-z][^<>\n]*>|\{\{[^{}\n]*\}\}|\[\[[^\[\]\n]*\]\]|\]\([^()\s]*\)|`[^`\n]*`|https?://\S+"
    r"|^[ \t]*(?:[-•*+]|\d{1,3}[.)]) ",
    re.M,
)
#: (opener, closer, whether a blank line ends the search) of what is no prose as a whole.
_ENCLOSED = [
    (re.compile(opener), re.compile(closer), near)
    for opener, closer, near in (
        (r"<!--", r"-->", False), (r"<table\b", r"</table>", False), (r"<h[1-6]\b[^<>]*>", r"</h[1-6]>", True), (r"<li\b[^<>]*>", r"</li>", True),
        (r"\\begin\{tabular\}", r"\\end\{tabular\}", False), (r"\\\(", r"\\\)", True), (r"\\\[", r"\\\]", True),
    )
]
_BREAK = "\x01"
_SUSPECT = re.compile(r"[#|<`{\\\[$=!>]|^[ \t]*(?:[-•*+]|\d{1,3}[.)]) |^[ \t]*(?:SELECT|FROM|WHERE|GROUP|ORDER|def|for|return|import|assert|total|rows)\b", re.M)


def _blank(m: re.Match) -> str:
    return _BREAK * (m.end() - m.start())


def prose(text: str) -> str:
    """The text with everything that isn't prose overwritten; positions stay."""
    if "```" in text:
        text = _FENCED.sub(_blank, text)
    if _SUSPECT.search(text):
        if "<" in text or "\\" in text:
            for kind in _ENCLOSED:
                out, end = [], 0
                for a, b in enclosed(text, *kind):
                    out += (text[end:a], _BREAK * (b - a))
                    end = b
                text = "".join([*out, text[end:]]) if out else text
        text = _NOT_PROSE.sub(_blank, text)
    return text


_TERMINAL = np.array([ord(c) for c in "。！？｡"], dtype=np.uint32)
#: Marks that end a sentence only before white space: elsewhere they stand in numbers or for misread letters.
_LOOSE = np.array([ord(c) for c in ".!?"], dtype=np.uint32)
_WHITE = np.array([1, 9, 10, 13, 32, 34, 0x201D, 0x300D], dtype=np.uint32)


#: Characters whose sentences are ranked together; bounds the arrays of a task, but for a longer sentence.
TOGETHER = 300_000
_CUT = re.compile(r"[\x01。！？｡]|[.!?](?=[\s\x01])|\n\n")


def sentence_languages(texts: list[str]) -> list[tuple[int, int, int, str, float]]:
    """(text number, begin, end, language, confidence) of every sentence that counts; a text's rows depend on that text only."""
    found: list[tuple[np.ndarray, ...]] = []
    parts: list[tuple[int, int, str]] = []  # (text number, offset, part)
    size = 0

    def flush() -> None:
        told = _ranked([part for *_, part in parts])
        if told:
            number, offset = (np.array([p[k] for p in parts])[told[0]] for k in (0, 1))
            found.append((number, told[1] + offset, told[2] + offset, *told[3:]))

    for number, text in enumerate(texts):
        for offset, part in _parts(prose(text)):
            if size and size + len(part) > TOGETHER:
                flush()
                parts, size = [], 0
            parts.append((number, offset, part))
            size += len(part)
    if parts:
        flush()
    if not found:
        return []
    text_of, a, b, best, sure, close, letters, counts = (np.concatenate(c) for c in zip(*found))
    best = _settled(best, sure, close, letters, text_of, len(texts))
    return [(int(text_of[i]), int(a[i]), int(b[i]), LANGUAGES[best[i]], float(sure[i])) for i in np.flatnonzero(counts)]


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text; only one longer than TOGETHER has several, each cut where a sentence ends."""
    begin = 0
    while len(text) - begin > TOGETHER:
        m = _CUT.search(text, begin + TOGETHER - 1)
        if not m or m.end() >= len(text):
            break
        yield begin, text[begin : m.end()]
        begin = m.end()
    yield begin, text[begin:]


def _grams(symbols: np.ndarray, kept: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owning sentence, index) of the profiles' n-grams, without those of ideographs only."""
    ones, twos, threes, *_ = profiles()
    wide = symbols == _IDEOGRAPH
    mixed = ~wide
    s = symbols.astype(np.uint32)
    pair = s[:-1] << 8 | s[1:]
    at1 = np.flatnonzero(mixed & (symbols > 0) & kept)
    at2 = np.flatnonzero((mixed[:-1] | mixed[1:]) & kept[:-1])
    # three symbols around a letter; they belong to the sentence of the middle one
    at3 = np.flatnonzero((mixed[:-2] | mixed[1:-1] | mixed[2:]) & kept[1:-1] & (symbols[1:-1] > 0))
    index = np.concatenate([ones[s[at1]], twos[pair[at2]], threes[pair[at3] << 8 | s[at3 + 2]]])
    who = np.concatenate([owner[at1], owner[at2], owner[at3 + 1]])
    known = index > 0
    return who[known], index[known]


def _settled(best: np.ndarray, sure: np.ndarray, close: np.ndarray, letters: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
    """Between languages that are hardly apart, the one that most of the text's clear sentences are in is taken."""
    clear = sure >= UNSURE
    weight = np.zeros((texts, len(LANGUAGES)))
    np.add.at(weight, (text_of[clear], best[clear]), letters[clear])
    mine = weight[text_of] * close
    return np.where(~clear & (mine.max(axis=1) > 0), mine.argmax(axis=1), best)


def _ranked(texts: list[str]) -> tuple[np.ndarray, ...] | None:
    """Of every sentence: text number, begin, end, nearest language, how much nearer than the next, which languages are as near, letters, whether it counts."""
    ones, twos, threes, ranks, weights, threes_of = profiles()
    joined = _BREAK + _BREAK.join(texts) + _BREAK
    codes = _codes(joined)
    starts_of = np.cumsum([1, *(len(t) + 1 for t in texts)])
    symbols = _symbols()[codes]
    n = len(codes)
    after = np.append(codes[1:], np.uint32(1))
    ended = np.isin(codes, _TERMINAL) | (np.isin(codes, _LOOSE) & np.isin(after, _WHITE))
    blank_line = np.zeros(n, dtype=bool)
    blank_line[1:] = (codes[1:] == 10) & (codes[:-1] == 10)
    # a sentence runs up to and with its mark; a break closes an open one
    closes = np.flatnonzero(ended | (codes == 1) | blank_line)
    begin = np.append(0, closes[closes < n - 1] + 1)
    end = np.append(begin[1:], n)
    letters = np.add.reduceat((symbols > 0).astype(np.int32), begin)
    counted = (letters >= LEAST_LETTERS) & ended[end - 1]
    total = int(counted.sum())
    if not total:
        return None
    a, b = begin[counted], end[counted]
    lengths = end - begin
    kept = np.repeat(counted, lengths)
    owner = np.repeat((np.cumsum(counted) - 1).astype(np.int32), lengths)
    who, index = _grams(symbols, kept, owner)
    # n-grams of ideographs only are counted by runs instead
    wide = (symbols == _IDEOGRAPH) & kept
    plain = [(ones[_IDEOGRAPH], wide), (twos[_IDEOGRAPH << 8 | _IDEOGRAPH], wide[:-1] & wide[1:]), (threes[_IDEOGRAPH << 16 | _IDEOGRAPH << 8 | _IDEOGRAPH], wide[:-2] & wide[1:-1] & wide[2:])]
    key = who.astype(np.uint32) << 13 | index.astype(np.uint32)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(key)))
    gram, whose = [(key[first] & 0x1FFF).astype(np.int64)], [(key[first] >> 13).astype(np.int64)]
    counts = [times]
    for i, mask in plain:
        if i:
            of = np.bincount(owner[: len(mask)][mask], minlength=total)
            has = np.flatnonzero(of)
            gram.append(np.full(len(has), i, dtype=np.int64))
            whose.append(has)
            counts.append(of[has])
    gram, who, times = np.concatenate(gram), np.concatenate(whose), np.concatenate(counts)
    order = np.argsort(who << 34 | np.maximum(0, (1 << 20) - times) << 13 | gram)
    gram, who, times = gram[order], who[order], times[order]
    heads = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
    rank = np.arange(len(who)) - np.repeat(heads, np.diff(np.append(heads, len(who))))
    load = times * weights[gram]
    distance = np.zeros((total, len(LANGUAGES)))
    for column in range(len(LANGUAGES)):
        placed = ranks[gram, column]
        out_of_place = np.where(placed < 0, PROFILE, np.minimum(np.abs(placed - rank), PROFILE))
        distance[:, column] = np.bincount(who, weights=out_of_place * load, minlength=total)
    best = distance.argmin(axis=1)
    # three-letter n-grams that the nearest profile knows, against all
    long = threes_of[gram] & (ranks[gram, best[who]] >= 0)
    known = np.bincount(who, weights=times * long, minlength=total) / np.maximum(letters[counted], 1)
    two = np.partition(distance, 1, axis=1)[:, :2]
    sure = np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0.0)
    text_of = np.searchsorted(starts_of, a, side="right") - 1
    close = distance * (1 - UNSURE) <= distance.min(axis=1, keepdims=True)
    ends = np.minimum(b - starts_of[text_of], np.array([len(t) for t in texts])[text_of])
    return text_of, a - starts_of[text_of], ends, best, sure, close, letters[counted], known >= LEAST_KNOWN


def segments(df: DataFrame, key: str = "chunk_key", text: str = "text", keep: str | None = None) -> DataFrame:
    """Rows (key, segment_no, char_start, char_end, lang, confidence): stretches of one language.

    Neighbouring sentences of a language form one stretch, whose confidence is
    the mean of theirs weighted by length. A text without a sentence of at least
    LEAST_LETTERS letters, and a null or empty text, gives no row; headings,
    table rows, code and markup don't count. ``keep`` names a column to carry
    along. Repeated rows are told each on their own.
    """
    kept = {"keep": keep} if keep else {}

    def make():
        def kernel(rows: dict[str, list]) -> pa.RecordBatch:
            out: list[tuple] = []
            index = [i for i, t in enumerate(rows["text"]) if t]
            told = sentence_languages([rows["text"][i] for i in index]) if index else []
            open_: list | None = None
            for t, a, b, lang, sure in [*told, (-1, 0, 0, "", 0.0)]:
                if open_ and open_[0] == t and open_[3] == lang:
                    open_[4] += sure * (b - a)
                    open_[5] += b - a
                    open_[2] = b
                    continue
                if open_:
                    i = index[open_[0]]
                    number = 1 + (out[-1][1] if out and out[-1][-1] == i else 0)
                    out.append((rows["key"][i], number, open_[1], open_[2], open_[3], open_[4] / max(1, open_[5]), rows["keep"][i] if keep else None, i))
                open_ = [t, a, b, lang, sure * (b - a), b - a]
            columns = list(zip(*out)) or [[]] * 8
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()] + ([pa.string()] if keep else [])
            names = [key, "segment_no", "char_start", "char_end", "lang", "confidence"] + ([keep] if keep else [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        return kernel

    schema = f"`{key}` bigint, segment_no int, char_start int, char_end int, lang string, confidence double" + (f", `{keep}` string" if keep else "")
    return map_texts(df, {"key": key, "text": text} | kept, schema, make)


def label_map(labels: DataFrame) -> DataFrame:
    """(profile, _named): the language each profile's label names, null for none; of repeated profiles the first by label."""
    spelled = F.create_map(*(F.lit(x) for lang, text in LABELS.items() for s in text.split() for x in (s, lang)))
    parts = F.filter(F.split(F.lower(F.coalesce("language", F.lit(""))), _PARTS), lambda p: p != "")
    first = F.try_element_at(parts, F.lit(1))
    return labels.groupBy("profile").agg(F.min("language").alias("language")).select("profile", F.when(first.isNotNull(), F.try_element_at(spelled, first)).alias("_named"))


def wrongly_labelled(chunks: DataFrame, labels: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Rows (key, lang): the languages of the chunks whose languages aren't exactly the one their profile names."""
    told = segments(chunks, key, "text", keep="profile").select(key, "lang", "profile").distinct()
    named = told.join(label_map(labels), "profile", "left")
    per_chunk = named.groupBy(key).agg(F.collect_set("lang").alias("_langs"), F.max("_named").alias("_named"))  # at most one entry a language
    wrong = per_chunk.where((F.size("_langs") > 1) | F.col("_named").isNull() | (F.col("_langs")[0] != F.col("_named")))
    return wrong.select(key, F.explode("_langs").alias("lang"))
