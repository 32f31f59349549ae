"""Messages, citations, titles and edits of a chat as Column builders (SC-14, SC-18, SC-19, SC-28, SC-30, SC-32, SC-35, SC-39, SC-43)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed

# Romanised Hindi words that aren't English, marks at the edges of titles, chart kinds, ordinals, what edits are said with in English, Hindi and romanised Hindi, words that frame a question.
HINGLISH = """
    hai hain tha thi thhe ho hoga hogi honge hota hoti hote hua hui hue kya kyaa kyu kyun kyon kaise kaisa kaisi
    kitna kitni kitne kaun kaunsa kaunsi konsa konsi kab kahan kaha kidhar kis kise kisne kiska kiski kiske mein mai
    mujhe mujhko mera meri mere humein hamein humko hamara hamari humara humari aap aapka aapki aapke apna apni apne
    tum tumhara tumhe yeh ye yah woh wo vo voh unka unki unke uska uski uske iska iski iske inka isme usme isse usse
    ka ki ke ko se ne tak aur lekin magar bhi toh nahi nahin nai haan ji acha achha accha theek thik sahi galat
    bilkul batao bataiye bataye bataen bolo boliye suno dekho samjhao samjhaiye samjha samjho karo kariye karna
    karke kar kiya kiye raha rahi rahe gaya gayi gaye diya diye liya liye lekar chahiye chahte chahta chahti sakte
    sakta sakti wala wali wale abhi ab phir fir wapas vapas chalo baat baare matlab yaani yani kuch sab sabse zyada
    jyada kam bahut bohot bahot saal pichle pichhle agle pehle baad dono aaj kal yaar bhai kripya dhanyavaad
    dhanyawad shukriya namaste jaankari jankari rupaye
""".split()
EDGES, TRAILING = "\"'`“”‘’„«»*_#>\\s", ".,;:!?…।॥\\-–—"
KINDS = {
    "donut": r"pie(?:\s+chart)?|donut(?:\s+chart)?|doughnut(?:\s+chart)?", "stacked_bar": r"stacked(?:\s+bars?)?(?:\s+chart)?", "grouped_bar": r"grouped\s+bars?(?:\s+chart)?|side\s+by\s+side\s+bars?",
    "waterfall": r"waterfall(?:\s+chart)?|bridge\s+chart", "bar": r"bar\s+(?:chart|graph)|bars|column\s+chart|bar", "line": r"line\s+(?:chart|graph)|trend\s+line|line", "table": r"table",
}
ORDINALS = {"first|1st": 0, "second|2nd": 1, "third|3rd": 2, "fourth|4th": 3, "fifth|5th": 4, "last|final": -1}
REMOVE = (
    r"remove|delete|drop|hide|close|discard|get\s+rid\s+of|take\s+(?:it\s+|that\s+|this\s+)?(?:away|off|down)|"
    r"हटा|हटाओ|हटाइए|हटाएं|हटाएँ|हटा\s+दो|हटा\s+दीजिए|मिटा|मिटाओ|मिटा\s+दो|"
    r"hata|hatao|hataiye|hatayein|hata\s*do|hata\s+dijiye|mita|mitao|mita\s*do"
)
CLEAR = (
    r"clear\s+(?:the\s+)?(?:canvas|screen|board|charts?|everything|all)|"
    r"(?:remove|delete|hide|close)\s+(?:all|every|everything)(?:\s+(?:the\s+)?(?:charts?|graphs?|visuals?))?|"
    r"(?:sab|sabhi|saare|sare|सब|सभी|सारे)\s+(?:\w+\s+)?(?:hata|hatao|hata\s+do|हटा|हटाओ|हटा\s+दो|मिटा\s+दो)"
)
UNPIN = r"unpin|un-pin|अनपिन|pin\s+(?:hata|hatao|hata\s+do|nikal\s+do)|पिन\s+(?:हटा|हटाओ|हटा\s+दो)"
PIN = r"pin|पिन|keep\s+(?:it|that|this)\s+(?:on\s+(?:the\s+)?screen|there)"
ADD = r"add|put|include|show|compare|plot|bring\s+in|jodo|jod\s+do|add\s+karo|add\s+kar\s+do|dikhao|daalo|dalo|जोड़ो|जोड़\s+दो|जोड़ें|दिखाओ|डालो"
ALONG = r"next\s+to|alongside|beside|too|also|as\s+well|with|against|bhi|भी|saath|साथ"
ONLY = "only|just|sirf|keval|केवल|सिर्फ़|सिर्फ"
QUESTION = "what|why|how|which|who|when|where|kyun|kyon|kaise|kaun|kitna|kitni|kitne|क्यों|कैसे|कौन|कितना|कितनी|कितने"
POINTING = "it|that|this|these|those|them|isko|isse|ise|isey|is|ye|yeh|usko|use|usse|wo|woh|vo|इसे|इसको|इस|यह|ये|उसे|उसको|उस|वो|वह"
CHANGE = rf"{POINTING}|as|into|instead|make|turn|change|switch|convert|redo|redraw|mein|me|में|ki\s+jagah|की\s+जगह|badlo|badal|बदलो|बदल|banao|बनाओ"
EDIT_VERB = "make|turn|change|switch|convert|add|put|include|replace|swap|show|plot|highlight|sort|only|just"
EDIT_WORDS = """
    make turn change switch convert redo redraw show display put draw plot give use see view let's lets let us me it
    that this them these those the same chart charts graph graphs visual panel one figure previous last instead
    please now can could would you will as into to in a an ok okay and so rather kindly version form format type
    style again just only like rather than of
    isko ise isey isse is ye yeh usko use usse wo woh vo ko mein me main men ek ki ke ka jagah ab zara thoda
    dikhao dikhaiye dikhaye dikha do dijiye banao banaiye bana badlo badal dalo karo kar kariye kijiye chahiye
    इसे इसको इस यह ये उसे उसको उस वो वह को में एक की के का जगह अब ज़रा थोड़ा
    दिखाओ दिखाइए दिखाएं दिखाएँ दिखा दो दीजिए बनाओ पनाओ बनाइए बना बदलो बदल करो कर कीजिए करें चाहिए चार्ट ग्राफ़ ग्राफ
    add include compare next alongside beside too also well with against bhi saath jodo jod daalo sirf keval
    भी साथ जोड़ो जोड़ जोड़ें डालो सिर्फ़ सिर्फ केवल
    na toh yaar bhai plz pls jara thora jaldi ना तो यार भाई जरा थोड़ा जल्दी
""".split()
FRAME = """
    a an the and or but if so nor of at to by for in on with without about around from into onto over under as than
    is are was were be been being am do does did has have had will would can could should may might shall must
    i me my mine we us our you your it its they them their he she him her his this that these those there here
    what whats which who whom whose when where why how hows whether also just only very really
    explain tell show give describe summarize summarise list find get check look say says said please kindly know
    let lets want need like help any some anything something everything
    today todays tonight now currently current latest recent recently live real time right moment week morning
    yesterday yesterdays tomorrow soon fy cy q h
""".split()
LIVE_TOPIC = r"(?i)\b(?:news|weather|stock price|share price|exchange rate|sensex|nifty|gold price)\b"
POINTER = r"(?i)\b(?:in|from|per|see|according to)\s+(?:the|my|our|this|that)\s+(?:annual\s+)?(?:report|documents?|files?|deck|policy|presentation)\b"
MARKER_LIST = r"\s*\[\s*[SWsw]\d+(?:\s*[,;]\s*[SWsw]\d+)*\s*\]"


def message_language(text: Column) -> Column:
    """SC-14: hi for Devanagari by word majority (ties too) and for romanised Hindi, en for other Latin text, null without words.

    Romanised: two words of the lexicon that make up a quarter of the Latin ones, or one among at most two."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    devanagari = F.filter(words, lambda w: w.rlike("[\\u0900-\\u097F]"))
    latin = F.filter(words, lambda w: ~w.rlike("[\\u0900-\\u097F]") & w.rlike("[A-Za-z\\u00C0-\\u024F]"))
    lexicon = F.array(*[F.lit(w) for w in HINGLISH])
    hindi = F.size(F.filter(latin, lambda w: F.arrays_overlap(F.split(F.lower(w), r"[^\p{L}]+"), lexicon)))
    nd, nl = F.size(devanagari), F.size(latin)
    romanised = ((hindi >= 2) & (hindi * 4 >= nl)) | ((hindi >= 1) & (nl <= 2))
    return F.when(nd + nl == 0, None).when((nd >= nl) | romanised, "hi").otherwise("en")


def spaced(text: Column) -> Column:
    """Lower case, letters and digits alone, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def echoes(text: Column, prompt: Column) -> Column:
    """SC-43: two words or more that only repeat part of the prompt."""
    t = spaced(text)
    return F.coalesce(F.contains(t, F.lit(" ")) & F.contains(spaced(prompt), t), F.lit(False))


def finalized(text: Column, known: Column) -> Column:
    """SC-19: struct<text, cited>: lists of markers as one marker a source, unknown ones gone with the space before, and what is cited in order of first mention."""
    gaps, found = F.split(text, MARKER_LIST, -1), F.regexp_extract_all(text, F.lit(MARKER_LIST), F.lit(0))
    ids = F.transform(found, lambda m: F.filter(F.array_distinct(F.transform(F.regexp_extract_all(m, F.lit(r"[SWsw]\d+"), F.lit(0)), lambda i: F.concat(F.upper(F.left(i, F.lit(1))), F.substring(i, 2, 9).try_cast("int").cast("string")))), lambda i: F.array_contains(known, i)))
    each = F.arrays_zip(found.alias("m"), ids.alias("ids"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"))
    shown = lambda x: F.when(F.size(x["ids"]) > 0, F.concat(F.regexp_extract(x["m"], r"^(\s*)", 1), F.array_join(F.transform(x["ids"], lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""))).otherwise("")
    whole = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(each, lambda x: F.concat(shown(x), x["gap"])), ""))
    return F.struct(F.trim(whole).alias("text"), F.array_distinct(F.flatten(ids)).alias("cited"))


def without_open_marker(text: Column) -> Column:
    """SC-19: a stopped answer without a marker that its end cuts."""
    return F.regexp_replace(text, r"\s*\[[^\]]{0,24}\z", "")


def table_snippet(text: Column, most: int = 6) -> Column:
    """SC-18: struct<lead, header, rows, truncated> of a Markdown table whose line ends are lost; null if there is none.

    The rule's cells tell how many columns there are; a row is so many cells and the empty one between two pipes."""
    flat = collapsed(text)
    at = F.locate("|", flat)
    cells = F.transform(F.slice(F.split(F.substring(flat, at, F.length(flat)), r"(?<!\\)\|", -1), 2, 100_000), lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\\|", "|"), r"(?i)<br\s*/?>", " "), r"\*\*|__", "")))
    is_rule = F.transform(cells, lambda c: c.rlike("^:?-{2,}:?$"))
    first = F.array_position(is_rule, F.lit(True)).cast("int")
    after = F.slice(is_rule, F.greatest(first, F.lit(1)), F.size(is_rule))
    stop = F.array_position(after, F.lit(False)).cast("int")
    columns = F.when(stop == 0, F.size(after)).otherwise(stop - 1)
    body = F.slice(cells, first + columns + 1, F.size(cells))
    count = F.greatest(F.ceil((F.size(body) - columns) / (columns + 1)).cast("int"), F.lit(0))
    rows = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(body, i * (columns + 1) + 1, columns))).otherwise(F.array().cast("array<array<string>>"))
    left = F.exists(F.slice(body, count * (columns + 1) + 1, F.size(body)), lambda c: c != "")
    good = (at > 0) & (first > 0) & (columns >= 2) & (first == columns + 2) & (F.get(cells, columns) == "")
    return F.when(good, F.struct(F.trim(F.left(flat, at - 1)).alias("lead"), F.slice(cells, 1, columns).alias("header"), F.slice(rows, 1, most).alias("rows"), (left | flat.endswith("…") | (count > most)).alias("truncated")))


def respelled(text: Column, renames: Column) -> Column:
    """SC-28: each misheard name as whole words, the longest first, by the documents' spelling; renames: map<string,string>."""
    longest = F.array_sort(F.map_entries(renames), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    quoted = lambda e: F.concat(F.lit("(?i)(?<![A-Za-z\\u0900-\\u097f])\\Q"), e["key"], F.lit("\\E(?![A-Za-z\\u0900-\\u097f])"))
    return F.aggregate(longest, text, lambda t, e: F.regexp_replace(t, quoted(e), e["value"]))


def spoken(text: Column) -> Column:
    """SC-30: an answer as it is read out: no markers or Markdown, abbreviations and scales as words, fiscal years spelled."""
    t = F.regexp_replace(F.regexp_replace(text, MARKER_LIST, ""), r"\*\*|__|`|^#+\s*", "")
    for pattern, word in ((r"₹\s?(\d+(?:[,.]\d+)*)\s*(?:cr\b|crores?\b)\.?", "$1 crore rupees"), (r"₹\s?(\d+(?:[,.]\d+)*)", "$1 rupees"), (r"(?i)\bFY\s?'?(?:20)?(\d{2})\b", "fiscal year $1"), (r"(\d)\s?%", "$1 percent"), (r"(?i)\bvs\.?(?=\s)", "versus"), (r"(?i)\be\.g\.", "for example"), (r"(?i)\bi\.e\.", "that is"), (r"\s?&\s?", " and ")):
        t = F.regexp_replace(t, pattern, word)
    return collapsed(t)


def _cut(text: Column, limit: int) -> Column:
    head = F.left(text, F.lit(limit - 1))
    word = F.regexp_extract(head, r"(?s)^(.*) [^ ]*\z", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.when(F.length(word) > limit // 2, word).otherwise(head), r"[ ,;:।]+\z", ""), F.lit("…")))


def clean_title(raw: Column, words: int = 6, most: int = 80, placeholder: str = "New chat") -> Column:
    """SC-32: the first line of a reply as a title: no markers, prefix, quotes, Markdown or closing marks; null if nothing is left."""
    line = F.get(F.filter(F.transform(F.split(raw, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    line = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(line, r"\*\*|__", ""), MARKER_LIST, "")), r"^[#> ]+", "")
    line = F.regexp_replace(line, r"(?i)^(?:chat\s+)?title\s*[:：\-–—]\s*", "")
    line = F.regexp_replace(line, rf"^[{EDGES}]+|[{EDGES}{TRAILING}]+\z", "")
    line = F.regexp_replace(F.array_join(F.slice(F.split(collapsed(line), " "), 1, words), " "), rf"[{EDGES}{TRAILING}]+\z", "")
    line = F.regexp_replace(_cut(line, most), "…\\z", "")
    return F.when((line != "") & (F.lower(line) != placeholder.lower()), line)


def fallback_title(question: Column, most: int = 60) -> Column:
    """SC-32: the first question, cut at a word, as a title."""
    t = F.regexp_replace(F.regexp_replace(collapsed(F.regexp_replace(question, MARKER_LIST, "")), rf"^[{EDGES}]+", ""), rf"[{EDGES}{TRAILING}]+\z", "")
    return F.nullif(_cut(t, most), F.lit(""))


def web_query(text: Column, said: Column, most: int = 120) -> Column:
    """SC-35: what may be searched on the web: no parts that point at documents, no file names, addresses, links, codes, nor figures that `said` doesn't hold (years stay);
    cut at a word; null with fewer than two content words, unless it names a live topic."""
    t = F.regexp_replace(text, POINTER, " ")
    for pattern in (r"(?i)\bhttps?://\S+|\bwww\.\S+", r"\S+@\S+\.\w+", r"(?i)\b[\w-]+\.(?:pdf|docx?|xlsx?|pptx?|csv|txt)\b", r"\b(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{8,}\b", r"\[[^\]]*\]|\(\s*\)"):
        t = F.regexp_replace(t, pattern, " ")
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    figure = lambda w: w.rlike(r"\d") & ~w.rlike(r"(?i)^\(?(?:FY\s?'?\d{2,4}|Q[1-4]|(?:19|20)\d\d(?:[-–/]\d{2,4})?)[).,;:?!]*$")
    kept = F.filter(words, lambda w: ~figure(w) | F.contains(said, F.regexp_replace(w, r"^[^\d]+|[^\d]+$", "")))
    line = F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), r"\s+([?.!,;:])", "$1"), r"^[\s,;:-]+|[\s,;:-]+\z", "")
    line = F.regexp_replace(_cut(line, most), "…\\z", "")
    content = F.filter(F.split(F.regexp_replace(F.lower(line), "['’]", ""), r"[^\p{L}]+"), lambda w: (w != "") & ~w.isin(FRAME))
    return F.when((F.size(content) >= 2) | line.rlike(LIVE_TOPIC), line)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(rf"(?<![\p{{L}}\p{{M}}])(?:{pattern})(?![\p{{L}}\p{{M}}])")


def kind_mentions(text: Column) -> Column:
    """SC-39: array of chart kinds that a text names, in order; of patterns that meet the longer kind counts."""
    n = F.lower(collapsed(text))
    every = "|".join(KINDS.values())
    found = F.regexp_extract_all(n, F.lit(rf"(?<![\p{{L}}\p{{M}}])(?:{every})(?![\p{{L}}\p{{M}}])"), F.lit(0))
    kind = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), k) for k, p in KINDS.items()])
    return F.transform(found, kind)


def ordinal_before(text: Column, nouns: str) -> Column:
    """SC-39: the place that an ordinal before one of the nouns says, from 0; -1 for the last."""
    n = F.lower(collapsed(text))
    return F.coalesce(*[F.when(has(n, rf"(?:{p})\s+(?:\p{{L}}+\s+)?(?:{nouns})"), i) for p, i in ORDINALS.items()])


def parsed_edit(utterance: Column) -> Column:
    """SC-39: struct<action, kind, target>: the edit of a chart that an utterance says; null for questions, long texts and whatever the grammar can't read."""
    n = F.regexp_replace(F.lower(collapsed(utterance)), r"[.!,;:]+", "")
    kinds, words = kind_mentions(n), F.size(F.split(n, " "))
    count = F.size(kinds)
    every = "|".join(KINDS.values())
    stripped = F.regexp_replace(n, rf"(?<![\p{{L}}\p{{M}}])(?:{every})(?![\p{{L}}\p{{M}}])", " ")
    period = r"\b(?:fy\s?'?\d{2,4}(?:-\d{2})?|q[1-4](?:\s?fy\d{2})?|(?:19|20)\d\d)\b"
    only_edit = lambda t: F.forall(F.filter(F.split(t, r"\s+"), lambda w: w != ""), lambda w: w.isin(EDIT_WORDS))
    timed = n.rlike(period) & only_edit(F.regexp_replace(n, period, " "))
    first, final = F.when(count > 0, F.get(kinds, F.lit(0))), F.when(count > 0, F.get(kinds, count - 1))
    edit = lambda a, k=None, t=None: F.struct(F.lit(a).alias("action"), (F.lit(None).cast("string") if k is None else k).alias("kind"), (F.lit(None).cast("string") if t is None else t).alias("target"))
    found = (
        F.when(has(n, CLEAR), edit("clear")).when(has(n, UNPIN), edit("unpin", t=first)).when(has(n, REMOVE) & (words <= 9), edit("remove", t=final)).when(has(n, PIN) & (words <= 9), edit("pin", t=final))
        .when(timed & has(n, ONLY), edit("only")).when(timed & (has(n, ADD) | has(n, ALONG)), edit("periods"))
        .when((count > 0) & only_edit(stripped) & ((count > 1) | has(stripped, CHANGE)), edit("kind", k=final, t=F.when(count > 1, first)))
        .when(has(n, EDIT_VERB) & n.rlike(r"\b(?:to|on|in|into|from|of)\s+(?:it|this|that|(?:the|that|this)\s+(?:\w+\s+)?(?:chart|graph|visual|table)s?)\b"), edit("model"))
    )
    question = F.trim(utterance).endswith("?") | has(n, QUESTION) | (words > 14) | (n == "")
    return F.when(~question, found)
