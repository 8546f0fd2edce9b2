"""Fixed values of the knowledge graph: allowed properties, type rules and wording."""

# Properties a chain may use, with the question, the cloze
# sentence and the attributive phrase for each. [S] stands for the subject and
# ___ for the object. Spelling is kept as published.
TEMPLATES: dict[str, tuple[str, str, str]] = {
    "P30": ("Which continent is [S] located in?", "[S] is located in the continent of ___.", "the continent where [S] is located"),
    "P36": ("What is the capital of [S]?", "The capital of [S] is ___.", "the capital of [S]"),
    "P35": ("Who is the current head of state in [S]?", "The current head of state in [S] is ___.", "the person who is the current head of state in [S]"),
    "P6": ("Who is the current head of the [S] government?", "The current head of the [S] government is ___.", "the person who is the current head of government of [S]"),
    "P20": ("Which city did [S] die in?", "[S] died in the city of ___.", "the city where [S] died"),
    "P26": ("Who is [S] married to?", "[S] is married to ___.", "the person who is married to [S]"),
    "P140": ("Which religion is [S] affiliated with?", "[S] is affiliated with the religion of ___.", "the religion that [S] is affiliated with"),
    "P1412": ("What language does [S] speak?", "[S] speaks the language of ___.", "the language that [S] speaks"),
    "P19": ("Which city was [S] born in?", "[S] was born in the city of ___.", "the city where [S] was born"),
    "P69": ("Which university was [S] educated at?", "The univerisity where [S] was educated is ___.", "the university where [S] was educated"),
    "P40": ("Who is [S]’s child?", "[S]’s child is ___.", "the child of [S]"),
    "P27": ("What is the country of citizenship of [S]?", "[S] is a citizen of ___.", "the country of citizenship of [S]"),
    "P175": ("Who performed [S]?", "[S] was performed by ___.", "the performer of [S]"),
    "P108": ("Which organization is the employer of [S]?", "[S] is employed by the organization ___.", "the organization that employs [S]"),
    "P112": ("Who founded [S]?", "[S] was founded by ___.", "the founder of [S]"),
    "P50": ("Who is the author of [S]?", "The author of [S] is ___.", "the author of [S]"),
    "P170": ("Who was [S] created by?", "[S] was created by ___.", "the creator of [S]"),
    "P407": ("Which language was [S] written in?", "[S] was written in the language of ___.", "the language that [S] was written in"),
    "P37": ("What is the official language of [S]?", "The official language of [S] is ___.", "the official language of [S]"),
    "P740": ("Which city was [S] founded?", "[S] was founded in the city of ___.", "the city where [S] was founded"),
    "P495": ("Which country was [S] created in?", "[S] was created in the country of ___.", "the country where [S] was created"),
    "P106": ("What kind of work does [S] do?", "[S] works in the field of ___.", "the field of work of [S]"),
    "P136": ("What type of music does [S] play?", "The type of music that [S] plays is ___.", "the type of music that [S] plays"),
    "P364": ("What is the original language of [S]?", "The original language of [S] is ___.", "the original language of [S]"),
    "P937": ("Which city did [S] work in?", "[S] worked in the city of ___.", "the city where [S] worked"),
    "P800": ("What is [S] famous for?", "[S] is famous for ___.", "the thing that [S] is famous for"),
    "P641": ("Which sport is [S] associated with?", "[S] is associated with the sport of ___.", "the sport that [S] is associated with"),
    "P413": ("What position does [S] play?", "[S] plays the position of ___.", "the position that [S] plays"),
    "P286": ("Who is the head coach of [S]?", "The head coach of [S] is ___.", "the head coach of [S]"),
    "P159": ("Which city is the headquarter of [S] located in?", "The headquarters of [S] is located in the city of ___.", "the city where the headquarters of [S] is located"),
    "P178": ("Who is the developer of [S]?", "[S] was developed by ___.", "the developer of [S]"),
    "P488": ("Who is the chairperson of [S]?", "The chairperson of [S] is ___.", "the chairperson of [S]"),
    "P169": ("Who is the chief executive officer of [S]?", "The chief executive officer of [S] is ___.", "the chief executive officer of [S]"),
    "P449": ("Who is the original broadcaster of [S]?", "The original broadcaster of [S] is ___.", "the original broadcaster of [S]"),
    "P176": ("Which company is [S] produced by?", "The company that produced [S] is ___.", "the company that produced [S]"),
    "P1037": ("Who is the director of [S]?", "The director of [S] is ___.", "the director of [S]"),
    "P39": ("What position is held by [S]?", "The position held by [S] is ___.", "the position held by [S]"),
}

# Fixed value: P30 has wording but is not walked.
ALLOWED_PROPS: tuple[str, ...] = tuple(p for p in TEMPLATES if p != "P30")

# Classes by name, and the class a property asks of its subject or object.
CLASSES = {"city": "Q515", "country": "Q6256", "organization": "Q43229", "person": "Q5"}
SUBJECT_RULES = {"P36": "country", "P35": "country", "P6": "city", "P159": "organization"}
OBJECT_RULES = {
    "P20": "city", "P19": "city", "P740": "city", "P937": "city", "P159": "city",
    "P27": "country", "P495": "country",
    "P108": "organization", "P176": "organization",
}
