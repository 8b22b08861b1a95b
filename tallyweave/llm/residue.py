"""Problem 9: template residue, filler, error pages and script notices in place of content.

Character n-gram models are fitted: over the characters of the text, for filler
and for error and script notices against natural prose, and over the text's shape
(letters, digits and ideographs reduced to classes), for unfilled placeholders.
Natural prose is the corpus itself, counted over all documents without the
sentences that already are residue under a model of general prose, so that
residue doesn't become natural by being frequent; filler, notices and
placeholders come from the seeds below.

Windows where the likelihood ratio sums up highest localise the residue. A line or
sentence that meets a window is filler or a notice by its likelihood alone: by the
mean log-likelihood ratio of its n-grams and by the share of it that n-grams of
residue cover, against thresholds fitted by cross-validation on the labelled seeds
and natural sentences of this module. N-grams with a digit count for neither, so
identifiers decide nothing. Placeholders are a matter of form; an exact check of
the lines under a window of shape follows. Documents are excluded by the share of
the text that residue covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import SAMPLES

#: Buckets of hashed n-grams: the size of a model, whatever the corpus.
BUCKETS = 1 << 18
#: Lengths of the n-grams of characters and of shapes.
GRAM, SHAPE_GRAM = 4, 3
#: Times that general prose counts beside the corpus; it matters for small corpora only.
PRIOR = 5.0

# Labelled seeds of the models: filler, natural sentences (headings, and sentences about pages, scripts and forms), errors, scripts, placeholders.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. Mauris turpis augue, semper vitae ligula.
Donec arcu erat, porta sed felis nec, risus nibh tellus, quam nostra fusce lorem per inceptos.
Nulla facilisi. Fusce porta mauris augue amet ligula vitae sed nulla tellus semper risus quam felis nibh erat arcu donec.
This is dummy copy for layout only. This is dummy text. Placeholder text goes here. Sample text, please replace.
Body copy, body copy, body copy. Description coming soon. Content coming soon. Your text here. Add your text here. Insert text here.
Text text text text text. Click to edit this block. Add a caption. Heading to be supplied. Replace this paragraph with your own content. Title goes here. Caption to come.
asdf asdf qwer asdf zxcv. asdf jkl; qwerty qwerty. xxxx xxxx xxxx. blah blah blah. test test test.
这里是示例文字，请替换为正文内容。此处为占位文本，排版时请删除。正文内容正文内容正文内容。测试测试测试，文字文字文字，段落段落段落。
（样例段落，仅用于版式预览）此处输入标题。请在此处输入正文。这是一段占位文字。点击编辑文本。内容待补充。标题待定。
Hier steht Blindtext. Dies ist ein Platzhaltertext. Texte fictif. Texte de remplissage. Texto de relleno. Texto de ejemplo. ここにテキストを入力してください。ダミーテキスト。サンプルテキスト
"""
NATURAL = """
Internal Control. Remuneration Report. Risk Management. Corporate Governance Report. Notes to the Financial Statements. Segment Information. Share Capital. Subsequent Events. Contents. Summary. Chairman's Statement. Item. Total. Unit.
Statement of Comprehensive Income. Related Party Transactions. Events after the reporting period. Independent auditor's report. Contact details of the registrar. Annual report, interim report and quarterly update for the year ended.
The report was approved by the board and signed by the chairman at the registered office. The meeting was held in the main hall and chaired by the finance director.
The website of the subsidiary was down for two days while its servers were moved to another data centre. A fault in the payment service stopped card payments for several hours, and customers were compensated.
Visitors who open the old address are redirected to the portal of the parent company. The help desk answered requests about expired passwords within one working day.
The team replaced scripts that had loaded the interest rates overnight, and errors in the import fell by half. The form asks for the name, the date and the amount, and all of them were filled in by the applicant.
Rechnungslegung. Lagebericht. Vergütungsbericht. Konzernanhang. Der Zugriff auf die Server wurde nach dem Umbau für drei Stunden unterbrochen, und die Kunden wurden vorab verständigt. Der Bericht wurde vom Vorstand genehmigt.
Rapport de gestion. Contrôle interne. Rapport annuel. Rapport semestriel. Comptes consolidés. La page des offres a été consultée deux fois plus qu'un an auparavant, et le service a répondu à toutes les demandes d'accès.
Informe anual. Informe semestral. Control interno. Informe de gestión. Cuentas anuales. El servicio de acceso de los clientes estuvo interrumpido una hora, y la sociedad publicó una nota en su página el mismo día.
内部控制。公司治理。风险管理。财务报表附注。目录。薪酬报告。公司网站于当日恢复访问，受影响的客户已得到通知。系统升级期间页面曾短暂无法打开，技术人员当晚完成了服务器的更换。
本报告由董事会批准报出。公司在年内更换了浏览器版本并停用了旧脚本，登录失败的次数明显减少。职工填写的申请表均已审核，金额、日期和名称齐全。编制单位及法定代表人见封面。
内部統制。注記事項。役員報酬。事業報告。ウェブサイトの表示が一時的に止まりましたが、翌日には復旧しました。サーバーの入れ替えにより応答が速くなり、利用者からの問い合わせも減りました。
"""
ERRORS = """
404 Not Found
403 Forbidden
410 Gone
400 Bad Request
401 Unauthorized
408 Request Timeout
429 Too Many Requests
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Time-out
HTTP Error 404 Not Found. HTTP Status 502 - Bad Gateway. Error 503: Service Unavailable
<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1><hr><center>nginx</center></body></html>
{"code": 401, "message": "session expired", "data": null, "trace": "6066"} {"error": "not found", "status": 404}
An unexpected fault occurred while rendering this document. Oops! Something went wrong on our end. Something went wrong, please try again later.
Sorry, the page you requested could not be found. Page not found. This page does not exist. Check the address or return to the home page.
Your session has expired, please sign in again. Access denied. You do not have permission to view this report. You have reached the download limit for today.
The connection was reset while the file was being fetched. This filing has been removed or is temporarily unavailable. We are performing scheduled maintenance.
The upstream document store did not answer. Unable to load the document viewer. The request timed out. This link has expired. Please try again later. The service is not available.
You will be redirected in 5 seconds. If the problem persists contact the administrator and quote. Go back | Home. Reload | Help. Reference: Request id node
抱歉，您访问的页面已被删除。哎呀，页面走丢了。该公告不存在或已下线。页面不存在。您请求的资源暂时无法访问。文件正在生成，请刷新重试。
系统繁忙，请稍后再试。服务器内部错误。会话已过期，请重新登录。访问被拒绝，您没有权限查看该报告。网络连接异常，请检查后重试。数据加载失败，点击重新加载。
当前访问人数过多，请排队等候。今日下载次数已达上限。系统维护中。请检查网址是否正确，或返回首页。返回上一页。页面将在 5 秒后自动跳转。如有疑问请联系管理员，错误编号。请求标识：
请求超时。链接已失效。文件不存在。刷新 关闭 联系客服 请登录后查看。文档服务没有响应。
Zugriff auf diesen Bericht verweigert. Bitte versuchen Sie es später erneut. Die Seite existiert nicht. Seite nicht gefunden. Die angeforderte Seite wurde nicht gefunden. Zugriff verweigert. Ihre Sitzung ist abgelaufen. Zurück zur Startseite. Kennung. Interner Serverfehler. Dienst nicht verfügbar.
Accès refusé à ce rapport. Revenez à l'accueil. Réessayez plus tard. Cette page n'existe pas. Page introuvable. La page demandée est introuvable. Accès refusé. Votre session a expiré. Retour à l'accueil. Erreur interne du serveur. Référence. Service indisponible.
No tiene permiso para ver este informe. Acceso denegado a este informe. Referencia. La página solicitada no existe. Inténtelo de nuevo más tarde. Página no encontrada. Acceso denegado. Su sesión ha caducado. Vuelva al inicio. Error interno del servidor. Servicio no disponible.
ページが見つかりません。この報告書へのアクセス権がありません。参照番号 トップページへ戻る。しばらくしてからもう一度お試しください。ただいまメンテナンス中です。アクセスが拒否されました。セッションの有効期限が切れました。トップページに戻る。サーバーエラーが発生しました。
"""
SCRIPTS = """
Loading... Loading document, please wait. If nothing happens, allow scripts for this site.
Please enable JavaScript to view this page. JavaScript is disabled. The annual report cannot be displayed. This viewer requires JavaScript. Enable it and reload the page.
You need to enable JavaScript to run this app. Please turn on scripts in your browser to view the filing. It looks like JS has been blocked. Unblock it to read on.
Checking your browser... enable cookies and scripts to continue. <noscript>Scripting must be switched on for the report reader.</noscript>
本页面需要 JavaScript 支持，请启用后重新加载。您的浏览器未启用脚本，请开启 JavaScript 后查看本报告。请在浏览器设置中打开脚本功能，否则公告全文无法显示。
检测到 JS 被禁用，部分内容不可见，请解除限制。为确认您不是机器人，请启用脚本与 Cookie 后继续。<noscript>请启用脚本以浏览报告正文</noscript> 正在加载…
Bitte aktivieren Sie JavaScript, um den Bericht anzuzeigen. JavaScript ist deaktiviert.
Veuillez activer JavaScript pour afficher ce rapport. JavaScript est désactivé.
Active JavaScript para ver el informe. Habilite JavaScript.
報告書を表示するには JavaScript を有効にしてください。
"""
PLACEHOLDERS = """
{{company_name}} {{ report_date | default }} {{period}} ${unit} ${net_profit} <<PERIOD>> <<total_assets>> «auditor» «company_name» [[RATIO_1]] [[CHAIRMAN]] {% segment %} {% company_name %}
%COMPANY_NAME% %UNIT% %(net_profit)s %(report_date)s @@unit@@ @@total_assets@@ __COMPANY_NAME__ __SEGMENT__ {company} {amount} {3} {0} [Insert period] [insert name here] [SEGMENT TBC] [COMPANY NAME TBC] [TBD] [●] [•] <company name> <insert date>
____ ______ ＿＿＿ □□□□ ×××  XX%  XXX XXXX TBD TBC #REF! #VALUE! #DIV/0! [  ] [___] [...] [company name] [date] [amount]
由XX于 为XX， 由XX批准 同比增长XX。 编制日期：XX； XX万元 XX年XX月XX日 在×××召开 ×××万元 B×××B
【●】 【公司名称】 【此处填写金额】 【此处填写比例】 【请填写】 ［请补充］ ［待补充］ [待定] （待填写） （待补充） （待定） {公司简称} {金额} {报告期} 〔待填〕 〈公司名称〉 年□□月□□日 职工□□□□人 {{total_assets}}万元 ${segment}% {报告期}%
"""
#: Placeholders whose shape is ordinary; their words tell them.
WORDED = """
（待填写） （待补充） （待定） （待确认） （请填写） （请补充） (to be completed) (to be confirmed) (please insert)
（待填写）万元 为（待填写）， 在（待填写）召开 持在（待填写）% 由（待填写）于
"""

# --- the exact check of placeholders ----------------------------------------------------------------------------

_NAME = r"[A-Za-z][\w.]*(?:\s*\|\s*\w+)?"
_PLACEHOLDER = re.compile(
    rf"\{{\{{\s*[^\W\d][\w.]*(?:\s*\|\s*\w+)?\s*\}}\}}|\$\{{\s*\w+\s*\}}|<<\s*\w[\w ]*\s*>>|«\s*[A-Za-z]\w*\s*»|\[\[\s*[A-Z][A-Z0-9_]*\s*\]\]|\{{%\s*{_NAME}\s*%\}}"
    r"|(?<![A-Za-z0-9%])%[A-Z][A-Z0-9_]*%(?![A-Za-z0-9])|%\([a-z]\w*\)[sdf]|@@\s*\w+\s*@@|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]*?__(?![A-Za-z0-9_])"
    r"|\{(?:\d{1,2}|[A-Za-z][A-Za-z_]*|[一-鿿]{1,8})\}"
    r"|[\[［【〔（(]\s*(?:insert|enter|please (?:insert|enter|complete|fill)|to be (?:completed|confirmed|determined|filled))\b[^\]］】〕）)\n]{0,40}[\]］】〕）)]"
    r"|[\[［【〔(（][A-Za-z0-9 _/-]{0,40}\b(?:TBC|TBD|TBA)[\]］】〕)）]"
    r"|[\[［【〔（(]\s*[●•○◯]\s*[\]］】〕）)]|[\[［]\s*(?:_{2,}|\.{3,}|…)\s*[\]］]"
    r"|[\[［【〔（(]\s*(?:请|此处|在此)?(?:填写|补充|填入|输入|录入|待填写|待补充|待填|待定|待确认|待核实)[^\]］】〕）)\n]{0,8}[\]］】〕）)]"
    r"|【[^】\n]{0,10}(?:名称|金额|比例|日期|时间|地址|姓名|简称|编号|单位|期间|年度|数字|数值|内容)】"
    r"|_{3,}|＿{2,}|□{2,}|×{2,}|█{3,}|#(?:REF|VALUE|DIV/0|NAME)[!?]"
    r"|(?<![A-Za-z])[Xx]{3,}(?![A-Za-z])(?=\s*(?:%|[一-鿿]|million|thousand))|(?:(?<=[^\x00-\x7f])|(?<=\d))X{2,}(?![A-Za-z])|(?<![A-Za-z])X{2,}(?=[^\x00-\x7f]|%)|\b(?:of|by|to|for|on|at|in) X{2,}(?= (?:million|thousand|billion|per cent|%|on|at|by)|[.,;%])",
)
_INSERT = re.compile(r"[\[［【]\s*(?:insert|enter|please insert|to be (?:completed|confirmed))\b[^\]］】\n]{0,40}[\]］】]", re.I)


#: What every placeholder holds; a quick look before the check.
_HINT = re.compile(r"[{}«»\[［【〔●○•◯＿□×█@#%]|__|XX|xx|Xx|[(（]|<<")


def placeholder(line: str) -> bool:
    return bool(_PLACEHOLDER.search(line) or _INSERT.search(line))


# --- n-gram models ----------------------------------------------------------------------------------------------

_CLASS = np.arange(0x110000, dtype=np.uint32)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_SHAPE = np.arange(0x110000, dtype=np.uint32)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("X")] = ord("X")
_SHAPE[0xC0:0x250] = ord("a")
_SHAPE[0xAB], _SHAPE[0xBB], _SHAPE[0xD7] = 0xAB, 0xBB, 0xD7
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x3040:0x3100] = 0x4E00
_SHAPE[0x3400:0xA000] = 0x4E00
_SHAPE[0x20000:0x32000] = 0x4E00


def grams(codes: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Bucket of the n-gram that begins at each position."""
    n = len(codes) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        h = h * np.uint64(1_000_003) + codes[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(46)).astype(np.int64)  # 18 bits


def letters(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].astype(np.uint64)


def shape(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(classes with runs of letters, digits and ideographs drawn together, where each begins)."""
    codes = _SHAPE[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    same = (codes[1:] == codes[:-1]) & np.isin(codes[1:], (ord("a"), ord("A"), ord("0"), 0x4E00))
    at = np.flatnonzero(np.r_[True, ~same]) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[at].astype(np.uint64), at


def _seed_counts(seeds: str, code, length: int) -> np.ndarray:
    counts = np.zeros(BUCKETS)
    for line in seeds.strip().split("\n"):
        np.add.at(counts, grams(code(line), length), 1)
    return counts


def _ratio(seeds: np.ndarray, natural: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each n-gram: positive unless common in prose; unseen in the seeds: negative."""
    s = (seeds + 0.02) / (seeds.sum() + 0.02 * BUCKETS)
    n = (natural + 1.0) / (natural.sum() + BUCKETS)
    ratio = np.log(s / n)
    ratio[seeds == 0] = np.minimum(ratio[seeds == 0], -1.0)
    return np.clip(ratio, -6.0, 6.0).astype(np.float32)


#: Kinds of residue that likelihood tells; of placeholders in words the exact check has the last say.
KINDS = ("filler", "error", "script", "placeholder")


@cache
def _kind_counts() -> np.ndarray:
    """Counts of the letter n-grams of each kind's seeds."""
    return np.stack([_seed_counts(seeds, letters, GRAM) for seeds in (FILLER, ERRORS, SCRIPTS, WORDED)])


@cache
def _kind_ratios() -> np.ndarray:
    """Log-likelihood of each n-gram under each kind."""
    counts = _kind_counts()
    return np.log((counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * BUCKETS)).astype(np.float32)


class Models:
    """Log-likelihood ratios of the n-grams of residue against natural prose: of letters, and of shapes."""

    def __init__(self, prose: np.ndarray, shapes: np.ndarray) -> None:
        general = PRIOR * _seed_counts("\n".join(SAMPLES.values()) + NATURAL, letters, GRAM)
        self.notice = _ratio(_kind_counts().sum(axis=0), prose + general)
        self.blank = _ratio(_seed_counts(PLACEHOLDERS, lambda s: shape(s)[0], SHAPE_GRAM), shapes)


@cache
def general_models() -> Models:
    """Models that know the natural sentences of this module and nothing of the corpus."""
    return Models(np.zeros(BUCKETS), PRIOR * _seed_counts("\n".join(SAMPLES.values()) + NATURAL, lambda s: shape(s)[0], SHAPE_GRAM))


# --- windows and passages ---------------------------------------------------------------------------------------

#: Sum of log-likelihood ratios from which a window counts.
FLOOR = 8.0
BLANK_FLOOR = 0.5
_SENTENCE_END = re.compile(r"[。！？!?]+|(?<=[a-z])\.(?=\s)")
_APART = "\n"


class Passages:
    """Lines and sentences of joined texts with what the letter model says of each."""

    def __init__(self, joined: str, notice: np.ndarray) -> None:
        codes = letters(joined)
        n = len(codes)
        # an n-gram counts from its first position; those over a line's end or with a digit count for nothing, a run of one character counts once
        odd = np.r_[0, np.cumsum((codes == ord("0")) | (codes == 10))]
        self.gram = grams(codes)
        plain = odd[GRAM:] == odd[:-GRAM] if n >= GRAM else np.zeros(0, dtype=bool)
        plain[1:] &= self.gram[1:] != self.gram[:-1]
        scores = np.where(plain, notice[self.gram], 0.0) if n >= GRAM else np.zeros(0)
        covered = np.zeros(n + 1, dtype=np.int64)
        hit = np.flatnonzero(scores > 0)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + GRAM, -1)
        in_residue = np.cumsum(covered)[:n] > 0
        self.scores, self.plain = scores, plain
        self._score, self._plain = np.r_[0.0, np.cumsum(scores), np.zeros(GRAM)], np.r_[0, np.cumsum(plain), np.zeros(GRAM, dtype=np.int64)]
        if n >= GRAM:
            self._score[len(scores) + 1 :], self._plain[len(plain) + 1 :] = self._score[len(scores)], self._plain[len(plain)]
        # identifiers belong to no side
        known = np.r_[odd[1:] == odd[:-1]]
        self._covered, self._known = np.r_[0, np.cumsum(in_residue & known)], np.r_[0, np.cumsum(known)]
        lines = np.r_[0, np.flatnonzero(codes == 10) + 1]
        self.lines = np.stack([lines, np.r_[lines[1:] - 1, n]], axis=1)
        ends = np.fromiter((m.end() for m in _SENTENCE_END.finditer(joined)), dtype=np.int64)
        cuts = np.unique(np.r_[lines, ends[ends < n], np.r_[lines[1:] - 1, n]])
        self.sentences = np.stack([cuts[:-1], cuts[1:]], axis=1) if len(cuts) > 1 else np.zeros((0, 2), dtype=np.int64)

    def windows(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the windows of highest sum, at least FLOOR each; none runs over a break."""
        if not len(self.scores):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        fall = np.zeros(len(self.scores))
        fall[np.maximum(0, np.minimum(breaks, len(fall)) - 1)] = -1e5  # starts the sum anew
        total = np.r_[0.0, np.cumsum(self.scores + fall)]
        run = total - np.minimum.accumulate(total)  # sum of the best window that ends here
        inside = run > 0
        begin = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        if not len(begin):
            return begin, begin
        best = np.maximum.reduceat(run, begin)
        begin, best = begin[best >= FLOOR], best[best >= FLOOR]
        # the rise to its highest sum is the window; what falls from there on is none
        stop = np.r_[np.flatnonzero(~inside & np.r_[False, inside[:-1]]), len(run)]
        stop = stop[np.searchsorted(stop, begin, side="right")] if len(begin) else begin
        end = np.array([b + int(np.argmax(run[b:e])) for b, e in zip(begin, stop)], dtype=np.int64)
        return begin - 1, end + GRAM - 1

    def stats(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean log-likelihood ratio, share of characters covered, number of n-grams) of spans."""
        a, b = spans[:, 0], spans[:, 1]
        last = np.maximum(a, b - GRAM + 1)
        n = self._plain[last] - self._plain[a]
        known = self._known[b] - self._known[a]
        return (self._score[last] - self._score[a]) / np.maximum(n, 1), (self._covered[b] - self._covered[a]) / np.maximum(known, 1), n

    def residue(self, spans: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which spans meet a window and are residue by their likelihood."""
        if not len(begin) or not len(spans):
            return np.zeros(len(spans), dtype=bool)
        least, share = thresholds()
        # windows don't overlap and are in order: the first that ends behind the span's begin
        i = np.minimum(np.searchsorted(end, spans[:, 0], side="right"), len(end) - 1)
        meets = np.minimum(end[i], spans[:, 1]) - np.maximum(begin[i], spans[:, 0]) >= GRAM
        mean, covered, n = self.stats(spans)
        return meets & (n > 0) & (mean >= least) & (covered >= share)

    def kind(self, a: int, b: int) -> str:
        """The kind whose seeds make the passage likeliest."""
        last = max(a + 1, b - GRAM + 1)
        chosen = self.gram[a:last][self.plain[a:last]]
        return KINDS[int(_kind_ratios()[:, chosen].sum(axis=1).argmax())]


#: Parts that the labelled sentences are dealt to; each part is judged by models fitted without it.
FOLDS = 5


def _labelled() -> tuple[list[str], list[str]]:
    """(residue, natural) sentences of the seeds."""
    cut = lambda text: [s for s in (x.strip() for line in text.strip().split("\n") for x in re.split(r"(?<=[。！？!?])|(?<=[a-zé]\.)\s", line)) if len(s) >= 8]
    return cut(FILLER + ERRORS + SCRIPTS), cut("\n".join(SAMPLES.values()) + NATURAL)


@cache
def held_out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether it is residue, mean ratio, share covered) of each labelled sentence, by models fitted without its part."""
    residue, natural = _labelled()
    rows = []
    for fold in range(FOLDS):
        seeds = _seed_counts("\n".join([WORDED, *(s for i, s in enumerate(residue) if i % FOLDS != fold)]), letters, GRAM)
        prose = PRIOR * _seed_counts("\n".join(s for i, s in enumerate(natural) if i % FOLDS != fold), letters, GRAM)
        ratio = _ratio(seeds, prose)
        for label, sentences in ((True, residue), (False, natural)):
            for i, sentence in enumerate(sentences):
                if i % FOLDS == fold:
                    told = Passages(sentence, ratio)
                    mean, covered, n = told.stats(np.array([[0, len(sentence)]]))
                    if n[0]:
                        rows.append((label, float(mean[0]), float(covered[0])))
    label, mean, covered = map(np.array, zip(*rows))
    return label, mean, covered


#: Share of held-out natural sentences that may be taken for residue at most.
FALSE_ALARMS = 0.01


@cache
def thresholds() -> tuple[float, float]:
    """(least mean ratio, least share covered) that find most held-out residue at no more than FALSE_ALARMS; of equals the middle pair."""
    label, mean, covered = held_out()
    best: list[tuple[float, float]] = []
    most = -1
    for least in np.arange(-2.0, 2.01, 0.25):
        for share in np.arange(0.3, 0.91, 0.05):
            called = (mean >= least) & (covered >= share)
            if (called & ~label).sum() <= FALSE_ALARMS * (~label).sum():
                found = int((called & label).sum())
                if found > most:
                    best, most = [], found
                if found == most:
                    best.append((float(least), float(share)))
    return best[len(best) // 2]


def find(texts: list[str], models: Models) -> list[list[tuple[int, int, str]]]:
    """Spans (begin, end, kind) of residue of each text: placeholder, filler, error or script."""
    found: list[set[tuple[int, int, str]]] = [set() for _ in texts]
    joined = _APART.join(texts)
    if not joined:
        return [[] for _ in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]

    def add(a: int, b: int, kind: str) -> None:
        t = int(np.searchsorted(starts, a, side="right")) - 1
        found[t].add((a - int(starts[t]), b - int(starts[t]), kind))

    told = Passages(joined, models.notice)
    begin, end = told.windows(starts[1:])
    for spans in (told.lines, told.sentences):
        for a, b in spans[told.residue(spans, begin, end)].tolist():
            if (kind := told.kind(a, b)) != "placeholder":
                add(a, b, kind)
    codes, at = shape(joined)
    places = np.r_[at[np.flatnonzero(models.blank[grams(codes, SHAPE_GRAM)] >= BLANK_FLOOR)], begin, end - 1]
    # a placeholder ends with its line, so the lines that the windows of either model meet hold it whole
    for i in np.unique(np.searchsorted(told.lines[:, 0], places, side="right") - 1).tolist():
        a, b = told.lines[i].tolist()
        for m in (*_PLACEHOLDER.finditer(joined, a, b), *_INSERT.finditer(joined, a, b)):
            add(m.start(), m.end(), "placeholder")
    return [sorted(spans) for spans in found]


def residue_of(text: str | None, models: Models) -> list[tuple[int, int, str]]:
    return find([text], models)[0] if text else []


# --- Spark ------------------------------------------------------------------------------------------------------

#: Characters of texts that are looked at together; bounds the arrays of a task. A longer text is looked at whole.
TOGETHER = 500_000


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of groups of about TOGETHER characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > TOGETHER:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, texts[first:]


def _natural_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of letters and shapes over the sentences that general prose doesn't call residue, and the lines without placeholder."""
    joined = _APART.join(texts)
    general = general_models()
    told = Passages(joined, general.notice)
    begin, end = told.windows(np.cumsum([len(t) + 1 for t in texts])[:-1])
    out = np.zeros(len(joined) + 1, dtype=np.int64)
    for spans in (told.lines, told.sentences):
        for a, b in spans[told.residue(spans, begin, end)].tolist():
            out[a] += 1
            out[b] -= 1
    kept = np.cumsum(out)[:-1] == 0
    counts = np.bincount(told.gram[kept[: len(told.gram)]], minlength=BUCKETS)
    codes, at = shape(joined)
    blank = grams(codes, SHAPE_GRAM)
    places = at[np.flatnonzero(general.blank[blank] >= BLANK_FLOOR)]
    numbers = np.unique(np.searchsorted(told.lines[:, 0], places, side="right") - 1)
    for i in numbers.tolist():
        a, b = told.lines[i].tolist()
        if _HINT.search(joined, a, b) and placeholder(joined[a:b]):
            kept[a:b] = False
    return counts, np.bincount(blank[kept[at[: len(blank)]]], minlength=BUCKETS)


def _counts(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams over the natural part of all texts: two vectors of BUCKETS numbers, summed up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for _, texts in groups([t for t in batch.column(0).to_pylist() if t]):
                prose, shapes = _natural_counts(texts)
                sums[0] += prose
                sums[1] += shapes
        model, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[model, bucket])], names=["model", "bucket", "n"])

    counted = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "model int, bucket int, n bigint").groupBy("model", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most 2 * BUCKETS rows
    sums = np.zeros((2, BUCKETS))
    sums[table.column("model").to_numpy(), table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return sums[0], sums[1]


def mark_residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, kinds, n_spans, coverage), one per input row.

    ``coverage`` is the share of the text's characters in residue. Null, empty
    and blank texts have no residue and coverage 0. Repeated rows stay repeated;
    other columns are not read; an empty table gives an empty table.
    """
    prose, shapes = _counts(df, text)
    table = Models(prose, shapes)
    # the two models (1 MB each) travel with the tasks
    models = df.sparkSession.sparkContext.broadcast((table.notice, table.blank))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Models.__new__(Models)
        local.notice, local.blank = models.value
        for batch in batches:
            bodies = [body or "" for body in batch.column(1).to_pylist()]
            names, spans, shares = [], [], []
            for _, texts in groups(bodies):
                for body, found in zip(texts, find(texts, local)):
                    covered, end = 0, 0
                    for a, b, _ in found:
                        covered += max(0, b - max(a, end))
                        end = max(end, b)
                    names.append(sorted({k for _, _, k in found}))
                    spans.append(len(found))
                    shares.append(covered / len(body) if body else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.int32()), pa.array(shares, pa.float64())], names=[key, "kinds", "n_spans", "coverage"])

    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"`{key}` {key_type}, kinds array<string>, n_spans int, coverage double")


def with_residue(df: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = 0.0) -> DataFrame:
    """Keys of the documents whose residue covers more than ``coverage`` of the text."""
    return mark_residue(df, key, text).where(F.col("coverage") > coverage).select(key).distinct()
