"""Problem 4: template residue, filler, error messages and script notices in place of content.

One automaton holds all phrases, in many languages, and the openings of template fields. It runs once over a page's
text; only where it finds something are template fields checked in full and the share of each block that is covered
by phrases measured. A block counts when phrases cover most of it; a page when such blocks hold most of its main
body, or when a field or filler stands in its title or in a block of its main body. What stands in code samples or
quotation marks, and sentences that merely mention an error, are left alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

from corvane.llm.blocks import Block

BLOCK_COVERAGE = 0.5  # of a block's letters: it is a message, not a sentence about one
HEAD_COVERAGE = 0.6  # of a title or of the page's own headline
PAGE_COVERAGE = 0.5  # of the main body's letters within such blocks

# Phrases of messages, by kind. "e" errors and refusals, "s" notices that scripts are needed, "f" filler.
PHRASES = {
    "e": """
not found|page not found|could not be found|could not be located|cannot be found|was not found|may have been moved|moved or renamed
no longer here|no longer available|no longer exists|does not exist any more|does not exist|has been removed|has been deleted
the page you were looking for|the page you requested|the requested item|the article you asked for|the requested url|the requested page
forbidden|access denied|you do not have permission|to view this resource|permission to view|not authorized|unauthorized
may not be opened from your region|not available in your region|not available in your country
session has expired|log in again|please log in|you must be logged in|sign in to continue
service temporarily unavailable|temporarily unavailable|service unavailable|server unavailable|guru code|cannot be shown right now
closed for maintenance|down for maintenance|under maintenance|under construction|site is being updated
something went wrong|on our side|try again in a few minutes|try again later|please try again|please come back later|check the address and try again|go back to the start
too many requests|your address has been blocked|has been blocked for|rate limit exceeded|are you a robot|verify you are human
account is suspended|account has been suspended|please ask the hosting provider|contact your hosting provider|this domain is parked
fatal error|uncaught exception|stack trace|traceback (most recent call last)|sqlstate|could not connect to server|could not connect|connection refused|connection timed out
error establishing a database connection|internal server error|bad gateway|gateway timeout|gateway time-out|bad request|error code|gave no answer in time|did not respond in time|upstream server|our database|this address|that document|the resource|the upstream|error 404|error 500|404 error|http error
we are afraid that|unfortunately|sorry|oops|cannot be shown|an error occurred|an unexpected error|we could not find
nicht gefunden|wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht mehr|nicht mehr verfügbar|die angeforderte seite|die gewünschte seite|zugriff verweigert|ihnen fehlt die berechtigung|keine berechtigung|für diesen inhalt|kein zugriff
vorübergehend nicht erreichbar|zurzeit nicht erreichbar|derzeit nicht erreichbar|nicht verfügbar|wird gerade gewartet|wird gewartet|bitte versuchen sie es später erneut|versuchen sie es später|später erneut|der dienst ist|der server ist|interner serverfehler|etwas ist schiefgelaufen|ein fehler ist aufgetreten|sitzung ist abgelaufen|wegen wartung|entschuldigung|leider|fehlercode|prüfen sie die adresse|zurück zum anfang
no encontrada|no encontrado|no hemos encontrado|la página solicitada|no existe|ya no existe|ya no está disponible|acceso denegado|no tiene permiso|para ver este contenido|no está disponible en este momento|el servicio no está disponible|vuelva a intentarlo más tarde|inténtelo de nuevo|inténtelo más tarde|error interno|ha ocurrido un error|algo salió mal|la sesión ha caducado|en mantenimiento|lo sentimos|el servidor no responde|no responde|código de error|compruebe la dirección|por desgracia|vuelva al inicio|el documento está
introuvable|est introuvable|cette page est introuvable|a été déplacée|n'existe plus|n'existe pas|accès refusé|vous n'avez pas les droits|pour voir cette page|vous n'êtes pas autorisé|temporairement indisponible|service indisponible|n'est pas disponible|veuillez réessayer|réessayez plus tard|réessayer plus tard|une erreur est survenue|erreur interne|la page ne répond pas|ne répond pas|session a expiré|en maintenance|désolé|un problème est survenu|code d'erreur|retour au début|vérifiez l'adresse|oups|le serveur n'existe
pagina non trovata|non trovata|non esiste più|accesso negato|non hai i permessi|non disponibile al momento|riprova più tardi|errore interno|si è verificato un errore|sessione scaduta|ci dispiace
página não encontrada|não encontrada|não existe|acesso negado|não tem permissão|indisponível no momento|temporariamente indisponível|tente novamente mais tarde|erro interno|ocorreu um erro|sessão expirou|lamentamos
pagina niet gevonden|niet gevonden|bestaat niet meer|toegang geweigerd|geen toestemming|tijdelijk niet beschikbaar|probeer het later opnieuw|interne serverfout|er is een fout opgetreden|helaas
sidan hittades inte|hittades inte|finns inte längre|åtkomst nekad|du har inte behörighet|inte tillgänglig för tillfället|försök igen senare|internt serverfel|ett fel har inträffat|tyvärr
nie znaleziono|nie została znaleziona|już nie istnieje|odmowa dostępu|brak uprawnień|nie masz uprawnień|chwilowo niedostępna|spróbuj ponownie później|wewnętrzny błąd|wystąpił błąd|przepraszamy
sayfa bulunamadı|bulunamadı|artık mevcut değil|erişim engellendi|erişim reddedildi|izniniz yok|şu anda kullanılamıyor|daha sonra tekrar deneyin|sunucu hatası|bir hata oluştu|üzgünüz
страница не найдена|не найдена|больше не существует|доступ запрещён|доступ запрещен|у вас нет прав|временно недоступен|временно недоступна|попробуйте позже|повторите попытку позже|внутренняя ошибка|произошла ошибка|к сожалению
сторінку не знайдено|не знайдено|більше не існує|доступ заборонено|немає прав|тимчасово недоступний|спробуйте пізніше|внутрішня помилка|сталася помилка|на жаль
η σελίδα δεν βρέθηκε|δεν βρέθηκε|δεν υπάρχει πλέον|δεν επιτρέπεται η πρόσβαση|προσωρινά μη διαθέσιμη|δοκιμάστε ξανά αργότερα|παρουσιάστηκε σφάλμα
ページが見つかりません|見つかりませんでした|アクセスが拒否されました|権限がありません|現在利用できません|後でもう一度お試しください|エラーが発生しました|内部エラー
页面未找到|找不到页面|页面不存在|您要查找的页面|拒绝访问|没有权限|暂时无法访问|服务不可用|请稍后再试|发生错误|内部错误
الصفحة غير موجودة|لم يتم العثور|تم رفض الوصول|ليس لديك إذن|غير متاح حاليا|حاول مرة أخرى لاحقا|حدث خطأ
""",
    "s": """
enable javascript|activate javascript|switch on scripts|turn on scripts|enable scripts|allow scripts|activate scripts|activate client-side|client-side scripting|scripting for this site|enable scripting|scripts are disabled|scripts are switched off|switch on javascript|turn on javascript|javascript is disabled|javascript is off|javascript is required|requires javascript|needs javascript|please activate javascript|javascript must be enabled|your browser blocks scripts|scripts must be switched on|needs scripts to run|turn them on in your browser|scripts to run|cannot start while|to view this page|for this site|reload the page|in your browser and reload|checking your browser|before you enter|if nothing happens|loading...|this application|this app
aktivieren sie javascript|javascript aktivieren|javascript einschalten|schalten sie javascript ein|um diese seite anzuzeigen|javascript ist deaktiviert|benötigt javascript
active javascript|activar javascript|habilite javascript|para ver esta página|necesita javascript|javascript está desactivado
activez javascript|activer javascript|pour afficher cette page|nécessite javascript|javascript est désactivé
abilita javascript|attiva javascript|per visualizzare questa pagina|ative o javascript|ativar o javascript|habilite o javascript|para ver esta página|schakel javascript in|javascript inschakelen|om deze pagina te bekijken|aktivera javascript|slå på javascript|för att visa sidan|włącz javascript|włączyć javascript|aby wyświetlić tę stronę|javascript'i etkinleştirin|bu sayfayı görüntülemek için|включите javascript|чтобы просмотреть эту страницу|увімкніть javascript|щоб переглянути цю сторінку|ενεργοποιήστε τη javascript|javascriptを有効にしてください|请启用 javascript|请启用javascript|启用 javascript|يرجى تفعيل javascript|تفعيل جافا سكريبت
""",
    "f": """
lorem ipsum|ipsum dolor|dolor sit amet|consectetur adipiscing|your title here|sample heading|headline goes here|title goes here|text goes here|your text goes here|replace this paragraph|before you publish|add a short description|of your company in this box|describe the item here|untitled page|untitled document|page title|document title|site title|new page|new post (draft)|insert text here|click to edit|edit this text|placeholder text|text text text|test test test|asdf asdf|xxxxx xxx|todo: write|write this section|coming soon|just another wordpress site|hello world! welcome|example heading
blindtext|hier steht ihr text|überschrift hier|titel hier eingeben|beispieltext|unbenannte seite|neuer beitrag|texto de ejemplo|escriba aquí su texto|título aquí|página sin título|texte d'exemple|votre texte ici|titre ici|page sans titre|saisissez votre texte|testo di esempio|inserisci il testo|texto de exemplo|insira o texto|voorbeeldtekst|exempeltext|tekst przykładowy|örnek metin|пример текста|введите текст|приклад тексту|サンプルテキスト|示例文本
""",
}
# Words of the customary Latin filler.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim"
    " veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit"
    " esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Openings of template fields, format strings and unresolved labels.
OPENINGS = "{{ ${ #{ <% [% [[ @@ ?? i18n: t(' missing_ %s %d %1$ __ [object null undefined nan .label .text .title .body .intro .headline .teaser .caption .name .header .button .description none nil todo: { %".split() + ["dear name"]
# Further openings of what FIELD and TECHNICAL find.
OPENINGS += ["order_no", "fatal error", "parse error: ", "warning: ", "uncaught ", "sqlstate[", "traceback (most recent", "exception in thread"]

FIELD = re.compile(
    r"\{\{\{?[^{}]+\}?\}\}|\$\{[^{}]+\}|#\{[^{}]+\}|<%[-=]?[^%]+%>|\[%[^%\]]+%\]|\[\[[\w .:-]+\]\]|@@[\w.-]{2,}@@"
    r"|\?\?[\w.-]{2,}\?\?|(?<![\w%])%[A-Za-z_][\w.-]{2,}%(?![\w%])|(?<!\w)__[A-Za-z][\w.-]+__(?!\w)|\{[A-Za-z_][\w.-]{2,}\}"
    r"|\bi18n:[\w.]+|\bt\('[\w.-]+'\)|\bMISSING_\w+|(?<![\w%])%(?:\d+\$)?[sd](?!\w)|\[object Object\]|\bDear NAME\b|\bORDER_NO\b"
)
LABEL = re.compile(r"[a-z][\w-]*(?:\.[a-z_][\w-]*){1,}\.(?:label|title|text|body|intro|headline|teaser|caption|name|header|button|description)")
EMPTY = re.compile(r"(?:\b(?:null|undefined|NaN|None|nil)\b[\s,;|]*)+")
#: Quotes of any length; straight ones open before a word and close behind one.
QUOTED = re.compile(r"(?<!\w)\"(?!\s)[^\"]*\"(?!\w)|[“„][^“”„]*[”“]|«[^«»]*»|[‚‘][^‚‘’]*[’‘]|「[^「」]*」|『[^『』]*』|(?<!\w)'[^'\s][^']*'(?!\w)")
#: What parts a page's own title from the site's name.
PARTS = re.compile(r"\s+(?:[|·•–—:»›-]|::)\s+")
#: Words that a message may hold beside its phrases; they count only next to a phrase.
GLUE = re.compile(
    r"\b(?:sorry|oops|hm|please|the page|this page|the document|the site|the server|the service|to continue|first|ref|error|reference|oups|désolé|malheureusement|la page|le document|le serveur|cette adresse"
    r"|die seite|das dokument|der server|fehler|bitte|lo sentimos|el documento|la dirección|el servidor|por favor|la pagina|a página)\b"
)
#: Words by which a sentence on scripts asks for them, in the languages of PHRASES.
NEED = re.compile(
    r"\b(?:allow|enable|activate|switch|turn|needs?|requires?|required|without|must|disabled|off|blocks?|ohne|aktivier\w*|erlauben|benötig\w*|sans|activ\w*|autoris\w*|nécessite|sin|habilit\w*|necesita|permit\w*|senza|attiv\w*"
    r"|abilit\w*|sem|ative|zonder|inschakel\w*|schakel|utan|aktivera|slå|bez|włącz\w*|etkinleştir\w*|olmadan|включит\w*|без|увімкн\w*|ενεργοποι\w*|χωρίς)\b|有効|なし|启用|没有|تفعيل|بدون",
    re.I,
)
SENTENCE = re.compile(r"[^.!?。！？؟]+")
SCRIPTING = re.compile(r"java ?script|\bscript(?:s|ing)?\b|\bskript\w*|скрипт|スクリプト|脚本|جافا", re.I)
LEAST_CUT = 8  # letters of a phrase that a cut title ends within
TECHNICAL = re.compile(r"(?:php )?(?:fatal error|parse error|warning): .{0,80}(?:exception|error|unexpected)|uncaught \w*(?:exception|error)|sqlstate\[|traceback \(most recent|exception in thread", re.I)
LETTERS = re.compile(r"[^\W_]", re.U)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, text in PHRASES.items():
        for phrase in re.split(r"[|\n]", text.strip()):
            a.add_word(phrase, (kind, len(phrase)))
    scripting = "javascript java script skript скрипт スクリプト 脚本 جافا".split()  # what SCRIPTING finds
    rare_filler = "eiusmod incididunt consectetur lorem fugiat nostrud laborum veniam mollit culpa".split()
    for opening in OPENINGS + scripting + rare_filler:
        if opening not in a:
            a.add_word(opening, ("t", len(opening)))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def longest_phrase() -> int:
    return max(map(len, automaton()))


def fold(text: str) -> str:
    """Lower case of the same length: the capital dotted I is the one letter whose lower case is longer."""
    return text.replace("\u0130", "i").lower()


def filler(low: str, quotes: bool = False) -> bool:
    """Whether a text in lower case is Latin filler, or with `quotes` could be once quoted parts are blanked. It may hold no word of the automaton."""
    words = re.findall(r"\w+", low)
    latin = sum(map(FILLER.__contains__, words))
    return latin >= 5 and (latin > 0.8 * len(words) or (quotes and QUOTED.search(low) is not None))


def touched(title: str, blocks: list[Block]) -> bool:
    """Whether anything of a page can be residue at all: one run over its text. Blanked samples may leave other text, so they are checked in full."""
    texts = fold("\n".join([title, *[b.text for b in blocks]]))
    return (
        next(automaton().iter(texts), None) is not None
        or any(b.sample for b in blocks)
        or _cut_phrase(fold(title)) is not None
        or any(filler(t, True) for t in texts.split("\n"))
    )


def kinds_of(text: str, samples: list[str] = (), cut: bool = False) -> dict[str, float]:
    """Share of a text's letters covered by phrases of each kind; "t" for template fields: 1 if there is one.

    With cut, as for titles, a phrase that the text ends within counts. Quoted parts and code samples are blanked first. A text without samples, in which the automaton finds nothing and that isn't filler, has no kinds.
    """
    if not samples and next(automaton().iter(low := fold(text)), None) is None and not filler(low, True) and not (cut and _cut_phrase(low)):
        return {}
    return _kinds_in_full(text, samples, cut)


def _kinds_in_full(text: str, samples: list[str] = (), cut: bool = False) -> dict[str, float]:
    for s in samples:
        text = text.replace(s.strip(), " ") if s.strip() else text
    bare = QUOTED.sub(lambda m: " " * len(m[0]) if not FIELD.fullmatch(m[0]) and "('" not in text[max(0, m.start() - 2) : m.end()] else m[0], text)
    out: dict[str, float] = {}
    if FIELD.search(bare) or LABEL.fullmatch(bare.strip()) or EMPTY.fullmatch(bare.strip()):
        out["t"] = 1.0
    if TECHNICAL.match(text.strip()):
        out["e"] = 1.0
    low = fold(bare)
    n = len(LETTERS.findall(bare))
    if not n:
        return out
    if filler(low):
        out["f"] = 1.0
    spans: dict[str, list] = {}
    for end, (kind, size) in automaton().iter(low):
        if kind != "t":
            a, b = end + 1 - size, end + 1
            if (a and low[a - 1].isalnum() and low[a].isalnum() and low[a] < "⺀") or (b < len(low) and low[b].isalnum() and low[b - 1].isalnum() and low[b - 1] < "⺀"):
                continue
            spans.setdefault(kind, []).append((a, b))
    if cut and (tail := _cut_phrase(low)):
        spans.setdefault(tail[0], []).append(tail[1:])
    glue = [m.span() for m in GLUE.finditer(low)] if "e" in spans or "s" in spans else []
    for kind, places in spans.items():
        covered = bytearray(len(low))
        if kind != "f":
            places = places + glue
        for a, b in places:
            covered[a:b] = b"\1" * (b - a)
        share = sum(c and ch.isalnum() for c, ch in zip(covered, low)) / n
        out[kind] = max(out.get(kind, 0.0), share)
    return out


def _cut_phrase(low: str) -> tuple[str, int, int] | None:
    """Kind and place of a phrase that the text ends within, as titles are cut at some length; the longest one."""
    for a in range(max(0, len(low) - longest_phrase()), len(low) - LEAST_CUT + 1):
        if (not a or not low[a - 1].isalnum()) and automaton().match(low[a:]):
            kind = next(automaton().values(low[a:]))[0]
            return None if kind == "t" else (kind, a, len(low))
    return None


def asks_for_scripts(text: str) -> float:
    """Share of a text that lies in sentences that ask for scripts."""
    if not SCRIPTING.search(text):
        return 0.0
    sentences = SENTENCE.findall(text)
    return sum(len(x) for x in sentences if SCRIPTING.search(x) and NEED.search(x)) / max(1, sum(map(len, sentences)))


def head_is_residue(title: str) -> bool:
    """Whether a title, or the part of it that stands beside the site's name, is a field, filler or a message."""
    for part in {title, *PARTS.split(title)}:
        kinds = kinds_of(part, cut=True)
        if kinds.get("t") or kinds.get("f", 0) >= BLOCK_COVERAGE or kinds.get("e", 0) >= HEAD_COVERAGE or kinds.get("s", 0) >= HEAD_COVERAGE:
            return True
    return False


def is_residue(title: str, blocks: list[Block], main: list[bool]) -> bool:
    """Whether title or main body is, or in part holds, residue instead of content.

    A page without blocks is judged by its title. Script notices count only where nothing else stands for content.
    """
    if head_is_residue(title):
        return True
    body = bad = notices = 0
    for b, m in zip(blocks, main):
        asks = not m and not b.noscript and SCRIPTING.search(b.text) is not None  # a notice need not stand in the main body
        if b.hidden or not (m or b.noscript or asks):
            continue
        kinds = kinds_of(b.text, b.sample)
        n = len(b.text)
        if m and (kinds.get("t") or kinds.get("f", 0) >= BLOCK_COVERAGE):
            return True
        top = b.path[-1:] and b.path[-1][:2] in ("h1", "h2")
        if m and top and b.path[-1][:2] == "h1" and kinds.get("e", 0) >= HEAD_COVERAGE:
            return True
        if kinds.get("s", 0) >= BLOCK_COVERAGE or asks_for_scripts(b.text) >= BLOCK_COVERAGE:
            notices += n
        elif not asks and kinds.get("e", 0) >= BLOCK_COVERAGE:
            bad, body = bad + n, body + n
        elif m and not (top or b.text.lower() == title.lower()):
            body += n
    return (bad + notices > 0) and bad + notices >= PAGE_COVERAGE * (body + notices) and (bad > 0 or body == 0)
