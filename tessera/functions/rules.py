"""Fixed values of the text cleaners: rule lists and word lists, applied in the order given."""


# Question cleaning. The first rule leaves only letters, digits and
# spaces, so rules that need other characters can never apply and are not listed.
QUESTION_RULES = [
    ("[^A-Za-z0-9]", " "),
    (" m ", " am "),
    ("60k", " 60000 "),
    (" e g ", " eg "),
    (" b g ", " bg "),
    (" 9 11 ", "911"),
    (r"\s{2,}", " "),
    ("quikly", "quickly"),
    (" usa ", " America "),
    (" USA ", " America "),
    (" u s ", " America "),
    (" uk ", " England "),
    (" UK ", " England "),
    ("india", "India"),
    ("switzerland", "Switzerland"),
    ("china", "China"),
    ("chinese", "Chinese"),
    ("imrovement", "improvement"),
    ("intially", "initially"),
    ("quora", "Quora"),
    (" dms ", "direct messages "),
    ("demonitization", "demonetization"),
    ("actived", "active"),
    ("kms", " kilometers "),
    ("KMs", " kilometers "),
    (" cs ", " computer science "),
    (" upvotes ", " up votes "),
    (" iPhone ", " phone "),
    ("calender", "calendar"),
    ("ios", "operating system"),
    ("gps", "GPS"),
    ("gst", "GST"),
    ("programing", "programming"),
    ("bestfriend", "best friend"),
    ("dna", "DNA"),
    ("III", "3"),
    ("the US", "America"),
    ("Astrology", "astrology"),
    ("Method", "method"),
    ("Find", "find"),
    ("banglore", "Banglore"),
    (" J K ", " JK "),
]

# Stop words of the question cleaner.
QUESTION_STOP_WORDS = [
    "the", "a", "an", "and", "but", "if", "or", "because", "as", "what", "which", "this", "that", "these", "those",
    "then", "just", "so", "than", "such", "both", "through", "about", "for", "is", "of", "while", "during", "to",
    "What", "Which", "Is", "If", "While", "This",
]

# The comment cleaner, in the order given. Word boundaries are those of Unicode text.
COMMENT_RULES = [
    ("&lt;3", " heart "),
    (":d", " smile "),
    (":dd", " smile "),
    (":p", " smile "),
    (r"8\)", " smile "),
    (r":-\)", " smile "),
    (r":\)", " smile "),
    (r";\)", " smile "),
    (r"\(-:", " smile "),
    (r"\(:", " smile "),
    ("yay!", " good "),
    ("yay", " good "),
    ("yaay", " good "),
    ("yaaay", " good "),
    ("yaaaay", " good "),
    ("yaaaaay", " good "),
    (":/", " worry "),
    (":&gt;", " angry "),
    (r":'\)", " sad "),
    (r":-\(", " sad "),
    (r":\(", " sad "),
    ("- :", ""),
    (":s", " sad "),
    (":-s", " sad "),
    ("(A|a)in't", "is not"),
    (r"\br\b", "are"),
    (r"\bu\b", "you"),
    (r"\bhaha\b", "ha"),
    (r"\bhahaha\b", "ha"),
    (r"\bdon't\b", "do not"),
    (r"\bdoesn't\b", "does not"),
    (r"\bdidn't\b", "did not"),
    (r"\bhasn't\b", "has not"),
    (r"\bhaven't\b", "have not"),
    (r"\bhadn't\b", "had not"),
    (r"\bwon't\b", "will not"),
    (r"\bwouldn't\b", "would not"),
    (r"\bcan't\b", "can not"),
    (r"\bcannot\b", "can not"),
    (r"\bi'm\b", "i am"),
    (r"\bI'm\b", "i am"),
    ("'s", "is"),
    (r"(\w+)'d", "$1 would"),
    (r"(\w+)'ll", "$1 will"),
    (r"(\w+)'ve", "$1 have"),
    (r"([a-z])\1{2,}", "$1"),
    ("'re", " are"),
    (r"\(UTC\) ", ""),
    ("fuckin", "fucking"),
    ("bithc", "bitch"),
    ("wtf", "what the fuck"),
    ("sUUck", "suck"),
    ("cck", "cock"),
    ("fckers", "fuckers"),
    (" r ", "are"),
    (" u ", "you"),
    ("haha", "ha"),
    ("hahaha", "ha"),
    ("don't", "do not"),
    ("doesn't", "does not"),
    ("didn't", "did not"),
    ("hasn't", "has not"),
    ("haven't", "have not"),
    ("hadn't", "had not"),
    ("won't", "will not"),
    ("wouldn't", "would not"),
    ("can't", "can not"),
    ("cannot", "can not"),
    ("i'll", "i will"),
    ("it's", "it is"),
    ("that's", "that is"),
    ("weren't", "were not"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", ""),
    (r"\[\[.*\]", ""),
    ("_", ""),
    (r"\d+", ""),
    (r"\s+", " "),
]
REPEATED_LETTER_RULE = (r"([a-z])\1{2,}", "$1")

# Contractions expanded before character n-grams; the text is lower case by then.
CHAR_GRAM_RULES = [
    ("won't", "will not"),
    ("can't", "can not"),
    ("i'm", "i am"),
    ("ain't", "is not"),
    (r"(\w+)'ll", "$1 will"),
    (r"(\w+)n't", "$1 not"),
    (r"(\w+)'ve", "$1 have"),
    (r"(\w+)'s", "$1 is"),
    (r"(\w+)'re", "$1 are"),
    (r"(\w+)'d", "$1 would"),
]

# Accented letters folded to their base letter.
ACCENTS = {"a": "āáǎà", "e": "êēéěèë", "i": "īíǐìïî", "o": "ōóǒòöô", "u": "ūúǔùǖǘǚǜüû", "c": "çÇč"}

# Patterns counted per comment.
COUNT_PATTERNS = {
    "ant_slash_n": r"\n",
    "nb_upper": "[A-Z]",
    "nb_fk": r"[Ff]\S{2}[Kk]",
    "nb_sk": r"[Ss]\S{2}[Kk]",
    "nb_dk": "[dD]ick",
    "nb_you": r"\W[Yy]ou\W",
    "nb_mother": r"\Wmother\W",
    "start_with_columns": r"^\:+",
    "has_timestamp": r"\d{2}|:\d{2}",
    "has_date_long": r"\D\d{2}:\d{2}, \d{1,2} \w+ \d{4}",
    "has_date_short": r"\D\d{1,2} \w+ \d{4}",
    "has_http": r"http[s]{0,1}://\S+",
    "has_mail": r"\S+\@\w+\.\w+",
    "has_emphasize_equal": r"\={2}.+\={2}",
    "has_emphasize_quotes": r'"{4}\S+"{4}',
}

# Marks kept as tokens of their own, and marks that bound a number.
SPLIT_MARKS = r"([&, !:()*.\-\"/;#?+~{\[\]}])"
NUMBER_RULE = (r"(^|(?<=[ ,.:?+;/\t]))([0-9]{2,})($|(?=[ ,.:?+;/\t]))", " numcus ")
ODD_CHARACTER = r"[^A-Za-z0-9,. :!?+;/\t']"
