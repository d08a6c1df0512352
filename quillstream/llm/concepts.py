"""What a masked unit of a mail is about: slots by syntax, the rest by concepts.

The lists below name things, states and actions in English, German, French,
Spanish, Portuguese, Japanese and Hindi, not sentences: a notice is a thing and
what befell it, in any order and with any words between. They are fixed values.
"""

from __future__ import annotations

import re

SLOT, VOID, BLANK, NUMBER = "<slot>", "<void>", "<blank>", "<num>"
#: Where a sentence goes on before or after a unit: no pattern takes it for the sentence's start or end.
CUT = "<cut>"

# ------------------------------------------------------------------ masking

# The marks around a field's name in common template languages and letter forms. Between « and » or << and
# >> only short texts are slots, since they are quotation marks too.
_SLOTS = re.compile(
    "|".join(
        [
            r"\{\{[^{}\n]{1,400}\}\}", r"\{%[^%\n]{1,400}%\}(?:\s*\{%[^%\n]{1,400}%\})*", r"<%=?[^%\n]{1,400}%>", r"\$\{[^{}\n]{1,400}\}", r"\$\([A-Za-z_][\w.]{1,60}\)", r"%%[A-Za-z_][\w.]{0,60}%%", r"%[A-Za-z_][\w.]{1,60}%",
            r"@@[A-Za-z_][\w.]{0,60}@@", r"\[\[[^\[\]\n]{2,400}\]\]", r"\{![^{}\n]{1,400}\}", r"\*\|[^|\n]{1,400}\|\*", r"#[A-Za-z_][A-Za-z_.]{2,60}#", r"(?<!\w)__[A-Za-z][A-Za-z_.]{0,60}?__(?!\w)", r"«[^«»\n]{1,60}»",
            r"<<[^<>\n]{1,60}>>", r"<(?:enter|insert|add|your|type|fill in|indicar|insertar|introduzca|ins[ée]rer|votre|hier|ihr|inserir|seu|nome)\b[^<>\n]{1,400}>",
            r"\[(?:your|insert|enter|add|type|fill in|indicar|insertar|introduzca|su|ins[ée]rer|indiquer|votre|hier|ihr|ihre|bitte|inserir|preencher|seu|sua)\b[^\[\]\n]{1,400}\]", r"\[[^\[\]\n]{1,400}(?:\bhere|\baquí|\baqui|\bici|\beintragen|\beinfügen|を入力|यहाँ\S*|लिखें|डालें)\]",
            r"(?<![\w\\}])\{(?:[A-Za-z_][\w.]{1,60}|\d)\}",
        ]
    ),
    re.I,
)
#: A field's name in single square brackets. At the start of a sentence or subject brackets are a tag, unless a
#: colon follows; in small letters they are a remark, unless they name what fields are called.
_FIELD_NAME = r"(?:[a-z]+ ){0,2}(?:name|firstname|lastname|surname|title|salutation|greeting|recipient|customer|client|company|manager|city|street|address|country|email|phone|id|no|number|date|duedate|period|month|amount|total|due|balance|anrede|vorname|nachname|datum|betrag|nom|prénom|montant|nombre|apellido|fecha|importe|nome|sobrenome|data|valor|名前|氏名|नाम)(?: [a-z]+)?"
_BRACKETED = re.compile(
    rf"(?:(?<=[\w,:] )|(?<=#))\[(?:[A-Z][A-Za-z]*[a-z][A-Za-z]*(?: [A-Z]?[A-Za-z]+){{0,2}}|[A-Z]{{3,}}(?:[_ ][A-Z]+)*)\](?!\()|(?<=[\w,:] )\[{_FIELD_NAME}\]|^\[(?i:{_FIELD_NAME})\](?=\s*:)|<(?:[A-Z][a-z]+){{2,4}}>|<[A-Z]{{2,}}(?:_[A-Z]+)+>"
)
# What programs print for a value that is not there; the first is no word of any language.
_OBJECT = "[object Object]"
# "None" at the start is an English word, unless a colon or a comma follows.
_VOIDS = re.compile(r"(?:(?<![\w/.-])(?:undefined|NaN|null(?! and void)|(?<!^)None|Invalid Date)|^None(?=\s*[:,]))(?![\w/-])(?: (?:undefined|NaN|null|None)(?![\w/-]))*")
# Runs of one letter or mark that hold a value's place.
_BLANKS = re.compile(r"(?<![\w/.-])(?:_{3,}|X{2,})(?![\w/-])")
_MARKS = re.compile(r"[{<%@#«*\[]|__|\$\(")
_VOID_HINT = re.compile(r"undefined|NaN|null|None|Invalid Date")
_STATUS = re.compile(r"(?<![\w.])[45]\d\d(?![\w.,]\d|\w)")
_URL = re.compile(r"[Hh][Tt][Tt][Pp][Ss]?://\S+")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
_NUMBERS = re.compile(r"\d+(?:[.,:/-]\d+)*")
_DIGIT = re.compile(r"\d")
# Pronouns of the first person; what is no pronoun when it is written large keeps its letters.
_PRONOUNS_LARGE = re.compile(r"(?<![\w/.-])(I|ICH|JE|EU|YO)(?![\w/-])")


def opened(text: str) -> str:
    """The text with its slots, void values and blanks masked."""
    t = text
    if _OBJECT in t:
        t = t.replace(_OBJECT, f" {SLOT} ")
    if _MARKS.search(t):
        t = _SLOTS.sub(f" {SLOT} ", t)
        t = _BRACKETED.sub(f" {SLOT} ", t)
    if _VOID_HINT.search(t):
        t = _VOIDS.sub(f" {VOID} ", t)
    if "XX" in t or "___" in t:
        t = _BLANKS.sub(f" {BLANK} ", t)
    return t


def masked(unit: str) -> str:
    """The unit with its variable parts masked, in lower case but for pronouns."""
    t = opened(unit)
    if "://" in t:
        t = _URL.sub("<url>", t)
    if "@" in t:
        t = _MAIL.sub("<mail>", t)
    if _DIGIT.search(t):
        t = _NUMBERS.sub(NUMBER, _STATUS.sub("<status>", t))
    t = " ".join(t.split())
    if _PRONOUNS_LARGE.search(t):
        return "".join(p if k % 2 else p.lower() for k, p in enumerate(_PRONOUNS_LARGE.split(t)))
    return t.lower()


# ------------------------------------------------------------------- speech

# The first person, times that have passed, reported speech and reasons: how people tell things.
_SPEECH = re.compile(
    r"(?<![\w/.-])(?:I|[Ii]ch|[Jj]e|[Jj]['’]ai|[Ee]u|[Yy]o)(?![\w/-])|\b(?:my|me|mich|mir|meine?[mnrs]?|moi|tuve|tive|meu|minha)\b|私|मैं|मुझे"
    r"|\b(?:yesterday|this (?:morning|afternoon|week)|last (?:night|week|month|year)|(?:on|last|next|by|since) (?:mon|tues|wednes|thurs|fri|satur|sun)day|(?:once|twice) (?:this|while)|ago|gestern|vorhin|heute morgen|am (?:montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag)|inzwischen|hier (?:soir|matin)|ce matin|ayer|esta mañana|ontem|esta manhã)\b|昨日|今朝|कल\b|आज\b"
    r"|\b(?:says?|said|told|asked|wrote|mentioned|complained|criticises?|sagte?|schrieb|écrit|dijo|escribió|disse|escreveu)\b|\b(?:because|although|weil|obwohl|parce que|porque)\b|\b(?:could|can|would) you\b|\bas (?:we )?(?:discussed|agreed)\b|\bwe (?:saw|got|had|sent|found out)\b|\bsee chapter\b",
)
# Words with which people speak of templates and fields rather than use them.
_META = re.compile(
    r"`|\"\s*:|\b(?:fields?|columns?|templates?|mail merge|merge (?:field|run|tag)s?|placeholders?|variables?|formula|config|regex|syntax|feld|felder|spalten?|vorlagen?|serienbrief|platzhalter|formel|champs?|colonnes?|modèle|publipostage|formule|campos?|columnas?|plantillas?|fórmula|colunas?|modelo|mala direta|printed|druck)\b|テンプレート|差し込み|項目|列|フィールド|फ़ील्ड|फील्ड|टेम्पलेट|कॉलम|टेम्प्लेट",
    re.I,
)
_QUOTED = re.compile(r"\"[^\"]{2,200}\"|“[^”]{2,200}”|„[^“”]{2,200}[“”]|«[^»]{2,200}»|「[^」]{2,200}」")


def spoken(unit: str) -> bool:
    return bool(_SPEECH.search(unit)) or unit.endswith(("?", "？"))


# -------------------------------------------------------------------- slots


def open_slot(unit: str) -> bool:
    """Does a masked unit show a slot, or a void value where a value belongs, rather than speak of it?"""
    return (SLOT in unit or void_used(unit)) and not _META.search(unit)


_GREETING = re.compile(rf"^(?:<cut> )?(?:[^\s,:;.!?<>]+ ){{1,3}}(?:{VOID}|{BLANK}) ?[,:!](?: |$)|^(?:{VOID}|{BLANK}) ?:")


# Words that greet.
_SALUTE = re.compile(rf"\b(?:hello|hi|dear|hallo|liebe[rs]?|guten tag|bonjour|cher|chère|hola|estimad[oa]|olá|prezad[oa]|caro)\b(?:/\w+)? (?:{VOID}|{BLANK})|(?:नमस्ते|प्रिय) (?:{VOID}|{BLANK})")


def void_used(unit: str) -> bool:
    """A void value or blank counts beside a slot or another one, in a greeting, before a colon, or in a bare heading."""
    if VOID not in unit and BLANK not in unit:
        return False
    if SLOT in unit or unit.count(VOID) + unit.count(BLANK) > 1 or _GREETING.search(unit) or _SALUTE.search(unit) and not spoken(unit):
        return True
    return VOID in unit and len(unit.split()) <= 3 and unit.endswith(VOID) and unit != VOID


# ------------------------------------------------------------------ scripts

# Scripts, and what pages that want them say of their state.
_SCRIPT = re.compile(r"java ?script|\bscripts\b|\bscripting\b|スクリプト|स्क्रिप्ट")
_SCRIPT_STATE = re.compile(
    r"\b(?:en|dis)abl|\b(?:de)?activ|\bturn(?:ed|ing)?\b|\bswitch(?:ed)?\b|\brequir|\bneeds?\b|\ballow|\bblock|\bsupport|\bwithout\b|\bavailable\b|\bnecessary\b|\bmust be\b|\bcannot be\b"
    r"|\b(?:de)?aktivier|schalte|\bbenötig|\berforderlich|\berlaub|\bzulassen|\bunterstützt|\bohne\b|\bactivez|\bdésactiv|\bnécessit|\brequis|\bautoris|\bbloqu|\bsans\b"
    r"|\bdesactiv|\b(?:des)?habilit|\brequier|\bnecesit|\bnecesari|\bpermit|\bsin\b|\b(?:des)?ativ|\brequer\b|\bexig|\bprecis|\bsem\b|有効|無効|オン|オフ|必要|許可|ブロック|सक्षम|अक्षम|चालू|बंद|सक्रिय|आवश्यक|ज़रूरी|अनुमति"
)
_BROWSER_CHECK = re.compile(r"\b(?:checking|verifying) (?:that )?(?:your browser|you are human|the security of your connection)")

# ------------------------------------------------------------------- errors

# The forms in which programs print failures.
_PROGRAM = re.compile(
    r"^(?:<cut>|\W)*(?:(?!<cut>)[\w.$<>-]+ ){0,2}(?:traceback \(most recent call last\)|exception in thread|segmentation fault|stack ?trace:|panic: |sqlstate ?\[|ora-<num>|unhandled exception|uncaught \w)|^\W*(?:[a-z]+ )?[\w.$]*(?:error|exception)\b ?: \S|^\W*(?:php )?(?:fatal|parse|runtime|template|application|server|syntax) (?:error|exception)\b ?(?::|in ')|^\W*file \"[^\"]+\", line\b|^\W*at [\w$]+(?:\.[\w$]+)+\s?\("
    r"|\btraceback \(most recent call last\)|\bwarning: .* on line\b|object reference not set|\bcore dumped|\bno module named\b|\berror establishing a\b|^\W*reference #\S|^\W*error code:? ?<num>"
)
# The reason phrases of the statuses 4xx and 5xx of HTTP, as they stand alone on a page.
_REASON = r"(?:bad request|unauthorized|forbidden|not found|method not allowed|not acceptable|request time-?out|too many requests|internal server error|not implemented|bad gateway|(?:the )?service (?:is )?(?:temporarily )?unavailable|gateway time-?out)"
_STATUS_LINE = re.compile(rf"^(?:(?!<cut>)\W)*(?:(?:http|error|status|code|server|fehler|erreur|erro|エラー|त्रुटि)[/ :<num>.-]*){{0,3}}<status>\W{{0,5}}(?:page |the |seite |página |{_REASON})|^(?:(?!<cut>)\W)*(?:fehler|erreur|error|erro|エラー|त्रुटि) ?<status>|^(?:(?!<cut>)\W)*<status>\W{{1,4}}(?:error|fehler|erreur|erro)\b|^(?:(?!<cut>)\W)*<status> ?{_REASON}|^\W*{_REASON}(?:\W*$| the server)|\(http <status>\)")
# What pages and programs deal with, and what befalls it.
_THING = re.compile(
    r"\b(?:web ?)?(?:page|site)\b|\burl\b|\bservers?\b|\bresource\b|\bdocument\b|\bdatabase\b|\bconnection\b|\bsession\b|\brequests?\b|\bservice\b|\bapplication\b|\baccess\b|\bthis message\b|\bview\b|\bfile\b"
    r"|\bseite\b|\bserver|\bdienst\b|\bzugriff\b|\bverbindung\b|\bsitzung\b|\bdatenbank\b|\bserveur\b|\baccès\b|\bconnexion\b|\bpágina\b|\bservidor\b|\bservicio\b|\bacceso\b|\bconexión\b|\bsesión\b|\bsitio\b|\bserviço\b|\bacesso\b|\bligação\b|\bconexão\b|\bsessão\b|ページ|サーバ|アクセス|接続|サービス|セッション|पेज|पृष्ठ|सर्वर|एक्सेस|सेवा|सत्र"
)
_FAILURE = re.compile(
    r"\bnot found\b|\bthe requested url\b|\b(?:can(?:not|'t| not)|could(?: not|n't)) (?:be (?:displayed|found|reached|loaded|completed)|load|display|take your|reach|connect|find the (?:page|url|server))|\bunavailable\b|\bnot available\b|\b(?:isn't|is not) (?:working|available|reachable)\b|\b(?:doesn't|does not|no longer) exists?\b|\bhas (?:been )?(?:moved|removed|expired|timed out|been denied)\b|\b(?:was|been) (?:denied|refused|interrupted)\b|\bdenied\W*$|\bdenied you\b|\brefused\b|\btimed out\b|\btook too long\b|\bwent wrong\b|\bencountered an? \w* ?error\b|\bdown for maintenance\b|\bdoes not allow access\b|\bpermission to (?:view|access)\b|\bproblem with the\b|\bunable to (?:connect|load|complete|display)\b|\bto see this page\b|\b(?:you are|you were) looking for\b"
    r"|\bnicht (?:gefunden|verfügbar|erreichbar|angezeigt)|\bvorübergehend nicht\b|\bverweigert\b|\babgelaufen\b|\bfehlgeschlagen\b|\bintrouvable\b|\bn['’]existe pas\b|\bindisponible\b|\brefusé|\bexpiré|\berreur interne\b|\bno (?:fue |ha sido |se ha )?encontrad|\bno existe\b|\bno (?:está )?disponible\b|\bdenegado\b|\bno se pudo\b|\bcaducado\b|\berror interno\b|\bnão (?:foi )?encontrad|\bnão existe\b|\bindisponível\b|\bnão está disponível\b|\bnegado\b|\bexpirou\b|\bnão foi possível\b|\berro interno\b|\bserverfehler\b|見つかりません|表示できません|拒否|利用できません|エラー|切れました|नहीं मिल|त्रुटि|अस्वीकृत|उपलब्ध नहीं|समाप्त"
)
# Failures that name no thing.
_APOLOGY = re.compile(
    r"\b(?:something|somewhat) went wrong\b|\ban? (?:unexpected |internal )error (?:has )?occurred\b|\byou have been (?:blocked|rate limited)\b|\btoo many requests\b|\b(?:sign|log) in again\b|\bunerwarteter fehler\b|\berreur inattendue\b|\berror inesperado\b|\berro inesperado\b|予期しないエラー|अप्रत्याशित त्रुटि"
)

# ------------------------------------------------------------------- filler

# Texts that stand for others, kinds of text, what is to be done with them, where and when.
_STAND_IN = r"(?:placeholder|dummy|filler|sample|blindtext|platzhalter|beispieltext|lorem ipsum|de remplissage|provisoire|de relleno|de ejemplo|de preenchimento|provisório|ダミー|サンプル|नमूना)"
_TEXT = r"(?:\b(?:text(?:o|e|s)?|copy|content|paragraph|headline|description|message|title|body|sentence|absatz|párrafo|parágrafo|contenido|contenu|conteúdo|paragraphe)\b|文章|本文|テキスト|पाठ|टेक्स्ट|संदेश)"
_PUT = r"(?:\b(?:insert|enter|type|write|add|put|replace|overwrite|delete|click to (?:add|edit)|geben sie|schreiben sie|einfügen|ersetzen|überschreiben|insérez|insérer|à insérer|saisissez|remplace[rz]|écrivez|inserte|introduzca|escriba|sustitu\w+|reemplac\w+|insira|escreva|substitu\w+)\b|入力|置き換え|लिखें|डालें)"
_HERE = r"(?:\b(?:here|in this (?:area|space|place|field|box)|hier|aquí|aqui|ici)\b|ここ|यहाँ)"
_FILLER = re.compile(
    rf"^(?:\S+ ){{0,4}}(?:{_STAND_IN}(?:text)?\W+(?:\w+\W+)?{_TEXT}\b|{_TEXT}\W+{_STAND_IN})|^\W*(?:{_STAND_IN}|beispiel)text\b|^\W*beispieltext\b|(?:blindtext|dummy text)\W+(?:blindtext|dummy text)|^\W*dummy text\W*$|ダミーテキスト|サンプルテキスト|नमूना पाठ"
    rf"|\b{_PUT}\b.*{_TEXT}.*{_HERE}|{_HERE}.*{_TEXT}.*{_PUT}|{_PUT}.*{_HERE}.*{_TEXT}|{_TEXT}.*{_PUT}.*\b{_HERE}|{_HERE}に?.*{_TEXT}|\b(?:your|the|own|ihr|votre|su|tu|seu) (?:\w+ )?{_TEXT}(?: (?:\w+ )?)?{_HERE}|\b{_TEXT} (?:goes|comes) {_HERE}|\btype something here\b|\b{_PUT} this {_TEXT}|\b(?:ersetzen|überschreiben) sie diesen|\bcliquez pour\b.*{_TEXT}"
    rf"|[(\[]\s*{_PUT} {_TEXT}\b[^()\[\]]*[)\]]|^\W*to be (?:completed|written|supplied|added|confirmed|determined|announced|provided)\W*$|^\W*(?:tbd|tba|tbc|to follow|to come)\W*$|^\W*{_TEXT} (?:to )?(?:follows?|come|folgt|suit|sigue|segue)\W*$|\bcoming soon\b.*{_TEXT}|\b{_TEXT} (?:comes )?later\b|\b{_TEXT} à venir\b|^\W*headline <num>\W*$|^\W*test message\b|\bbla(?:h)?\W+bla(?:h)?\b|\bhere comes the\b.*{_TEXT}|^\W*click (?:here )?to (?:add|edit)\b|\bhier (?:kommt|steht|könnte)\b.*{_TEXT}",
)
# Pseudo-Latin that typesetters use.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat perspiciatis unde omnis iste natus voluptatem accusantium doloremque laudantium totam rem aperiam duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat".split()
)
# Words that are written to fill a place.
_EMPTY_WORDS = frozenset("blah bla foo bar baz test xxx".split())
# The rows of letters of common keyboards, on which hands that hit keys at random slide along.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm")
# The commonest function words of the languages in Latin script.
_FUNCTION = frozenset(
    "the a an of to in is it and or for on at by with we you i our your this that be are was not from as but have has been they he she will can if there all no so its do"
    " der die das und ist nicht ein eine den dem des zu mit von für auf im am bei wir sie ich es noch aus an sind wird uns er"
    " le la les un une et est de du des à au aux pour dans en par sur nous vous je il elle pas ce se que qui avec"
    " el los las y es del al por con para su no se que lo una como más"
    " o os as e do da dos das em no na um uma por com para não que ao".split()
)
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


_SLIDES = frozenset(row[k : k + 3] for row in _ROWS for k in range(len(row) - 2))


def is_mash(word: str) -> bool:
    """Keys hit along the rows of a keyboard, three or more at a time."""
    at = 0
    while word[at : at + 3] in _SLIDES:
        at += 3
        while at < len(word) and word[at - 2 : at + 1] in _SLIDES:
            at += 1
    return at == len(word) > 0


def is_filler_words(unit: str) -> bool:
    """Pseudo-Latin, keys hit at random or one word over and over: words that say nothing.

    Three words or more, all of them empty or keys hit at random; or four or
    more, none a function word, most of them pseudo-Latin or repeated; or words
    of one letter over and over.
    """
    words = [w.lower() for w in _WORDS.findall(re.sub(r"<\w+>", " ", unit) if "<" in unit else unit)]
    if not words:
        return False
    if all(len(w) >= 2 and w == w[0] * len(w) for w in words) and max(map(len, words)) >= 5:
        return True
    if len(words) >= 3 and len(words[0]) >= 3 and words.count(words[0]) == len(words):
        return True
    if len(words) < 3 or any(ord(w[0]) > 0x24F for w in words):
        return False
    latin = sum(w in _LATIN for w in words)
    if len(words) >= 4 and latin * 2 > len(words) and ("lorem" in words or "ipsum" in words or latin >= 6):
        return True
    if not _FUNCTION.isdisjoint(words):
        return False
    empty = sum(w in _EMPTY_WORDS or is_mash(w) for w in words)
    if empty == len(words):
        return True
    if len(words) < 4:
        return False
    if "lorem" in words and "ipsum" in words or len(words) >= 5 and latin >= 2 and latin * 4 >= len(words):
        return True
    distinct = len(set(words))
    return (empty + latin) * 10 >= len(words) * 9 or len(words) >= 8 and distinct * 4 <= len(words) * 3 and max(map(len, words)) < 16


# ------------------------------------------------------------------ verdict

_DECIDING = (_SPEECH, _META, _SALUTE, _SCRIPT, _SCRIPT_STATE, _BROWSER_CHECK, _PROGRAM, _STATUS_LINE, _THING, _FAILURE, _APOLOGY, _FILLER)
_ALL_STEMS = {w for p in _DECIDING for w in re.findall(r"[^\W\d_]+", re.sub(r"\\.", " ", p.pattern).lower())}
_STEMS = frozenset(w for w in _ALL_STEMS if len(w) >= 3) - _FUNCTION | _LATIN | _EMPTY_WORDS | {"not", "can", "has", "was"}
_SPACELESS_STEMS = tuple(w for w in _ALL_STEMS if ord(w[0]) > 0x2FF)
_SPACELESS = re.compile(r"[\u0900-\u097f\u3040-\u30ff\u4e00-\u9fff]")
_EDGES = ".,;:!?()[]*\"'«»“”„-–…/#>"
_MARKED = re.compile(r"<(?:slot|void|blank|status|cut)>|n't\b|\b(?:i|ich|je|eu|yo|me)\b|[\"`?“„«「]|^[(\[]", re.I)


def telling(word: str) -> bool:
    """Words that a template keeps: those that may decide its verdict, which the patterns above name."""
    if _MARKED.search(word):
        return True
    if _SPACELESS.search(word):
        return any(w in word for w in _SPACELESS_STEMS)
    return any(w[:k] in _STEMS for w in word.strip(_EDGES).lower().replace("'", "-").replace("’", "-").split("-") for k in range(3, len(w) + 1)) or is_mash(word)


# Words, and parts of words in scripts without spaces, one of which every match of the patterns above holds: a unit
# without any needn't be put to the pattern.
_OF_THINGS = frozenset("page webpage site website url server servers resource document database connection session request requests service application access message view file seite dienst zugriff verbindung sitzung datenbank serveur accès connexion página servidor servicio acceso conexión sesión sitio serviço acesso ligação conexão sessão".split())
_OF_APOLOGIES = frozenset("wrong error blocked limited requests again fehler inattendue inesperado".split())
_OF_FILLER = frozenset(
    "placeholder dummy filler sample blindtext platzhalter platzhaltertext beispieltext lorem remplissage provisoire relleno ejemplo preenchimento provisório text texto texte texts copy content paragraph headline description message title body sentence absatz párrafo parágrafo contenido contenu conteúdo paragraphe diesen cliquez bla blah here click tbd tba tbc follow come be something line section".split()
)


def _words(unit: str) -> set[str]:
    return {x for w in unit.split() for x in w.strip(_EDGES).replace("/", " ").replace("-", " ").replace("'", " ").replace("’", " ").split()}


def candidate(unit: str) -> str | None:
    """What a masked unit is by its words: slot, filler, error, scripts, void (a value may be missing) or None.

    Errors and notices are candidates: whether they stand for a message or amid
    one is for their mails to say.
    """
    found = _notice(unit)
    if found and (_PROGRAM.search(unit) or not (_SPEECH.search(unit) if found == "filler" else spoken(unit))):
        return found
    if open_slot(unit):
        return "slot"
    return "void" if (VOID in unit or BLANK in unit) and not _META.search(unit) else None


def _notice(unit: str) -> str | None:
    bare = _QUOTED.sub(" ", unit) if any(q in unit for q in "\"“„«「") else unit
    words, spaceless = _words(bare), bool(_SPACELESS.search(bare))
    if _SCRIPT.search(bare) and _SCRIPT_STATE.search(bare) or _BROWSER_CHECK.search(bare):
        return "scripts"
    if _STATUS_LINE.search(bare) or (spaceless or not _OF_APOLOGIES.isdisjoint(words)) and _APOLOGY.search(bare):
        return "error"
    if (spaceless or not _OF_THINGS.isdisjoint(words) or "server" in bare) and _THING.search(bare) and _FAILURE.search(bare):
        return "error"
    if (spaceless or not _OF_FILLER.isdisjoint(words)) and len(unit.split()) <= 30 and _FILLER.search(bare) or is_filler_words(unit):
        return "filler"
    return "error" if _PROGRAM.search(unit) else None
