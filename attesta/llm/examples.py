"""Labelled examples for the personal-data trees, made from a rule: templates filled with seeded random values.

Whether a planted string is personal data is known from how it was made, not from its format: the same
shape stands on both sides (a fifteen-digit card and a fifteen-digit order number, a phone number in
threes and a population in threes), so that format and context have to be weighed. A tenth of the
order numbers pass the check digit of cards by chance, as in any text.

Every template belongs to one fold: those of the calibration fold teach nothing, so that thresholds,
precision and recall are measured on wordings that the trees have not seen.
"""

from __future__ import annotations

import random

#: Examples of each template, and of every how many templates one is kept for calibration.
FILLS, FOLDS = 24, 4

FIRST = "anna joe maria peter li omar ines jonas chloe tomas ada ravi sven lucia kim nadia".split()
LAST = "smith weber rossi lopez martin chen novak haddad jensen silva moreau kaya brandt costa".split()
HOSTS = "example mailhost acme nordwind postbox webshop studio atelier klinik garage inbox verlag".split()
TOPS = "com org net de fr es it nl ch at io eu info co.uk com.br".split()
PLACES = "noon home school two midnight work lunch once first last night dawn sea least most all".split()
SUBJECTS = "they she he we nobody people guests it everyone trains".split()
VERBS = "arrived met looked works stayed left stood laughed aimed shouted lived started".split()
NEXT = "Then She He It The Nobody We After Later In But And This Everyone".split()

# Fixed wordings; {} is the place of the string.
#: Wordings that say nothing of what the string is.
NEUTRAL = ["{}", "then {} again", "it says {} there", "{} and so on", "there was {} at the end", "on the wall: {}", "next to {} and the door", "with {}", "or {}", "the {} thing", "und {} dazu", "a, {}, b"]
#: Wordings in which personal data stands, by kind.
POSITIVE = {
    "email": ["write to {} please", "contact: {}", "{} is where to reach me", "you can mail {} any time", "or ask {} about the keys", "- {}; the office", "send the form to {}, thanks", "e-mail {}", "her address: {}", "author {} 2019", "({})", "questions? {}"],
    "ip": ["the host {} answered", "from {} port 22", "server at {} is down", "blocked ip {} again", "address {} was seen", "login by {}", "ping {}", "attack from {}; see the log"],
    "card": ["card {} was charged", "paid by visa {}", "credit card no {}", "my card number is {}", "charge {} please", "payment {} exp 04/27", "pay with {}", "amex {}", "card: {}"],
    "phone": ["call {} now", "phone: {}", "tel. {}", "you can reach me on {}", "my mobile is {}", "fax {}", "dial {} for help", "contact {} at the desk", "({}, ask for Jo)", "Tel {}", "ring us: {}", "office {}"],
}
#: Wordings in which strings of the same shapes are something else, some with the words of personal data.
NEGATIVE = {
    "date": ["dated {}", "since {}", "version of {}", "from {} on", "published {}", "{}: first draft", "due {}", "call me on {}", "the card was made on {}", "contact us by {}"],
    "amount": ["a population of {}", "{} inhabitants", "it cost {} euros", "{} km away", "$ {}", "some {} people came", "worth {} in total", "{} visitors", "pay {} by friday", "calls rose to {}", "credit of {}"],
    "order": ["order {}", "order no. {} shipped", "invoice {}", "ref {}", "ticket {} closed", "tracking {}", "serial {}", "item {} in stock", "id {}", "call about order {}", "we charge order {}"],
    "isbn": ["ISBN {}", "isbn: {}", "book {}", "see {} (hardcover)", "call for book {}"],
    "list": ["rows {} follow", "scores {}", "chapters {}", "results: {}", "port {} open", "cards {} drawn"],
    "section": ["see section {} below", "version {} of the rules", "chapter {}", "release {}", "from {} on"],
    "prose": ["{} the day was over", "and {} came home", "it was said that {} sat down", "the anecdote goes: {} began", "dot by dot, {} spoke", "{} ended it", "write that {} came", "we ask: {} stood"],
    "pointer": ["see more {}", "read on {}", "buy {} today", "was seen {} once", "contact the shop {}"],
}


def check_digit(body: str) -> str:
    """``body`` with the digit that makes it pass the check of card numbers."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def _digits(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))


def _grouped(text: str, sizes, sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(text[at : at + n])
        at += n
    return sep.join(p for p in [*out, text[at:]] if p)


def email(r: random.Random) -> str:
    name = r.choice([r.choice(FIRST), f"{r.choice(FIRST)}.{r.choice(LAST)}", f"{r.choice(LAST)}{r.randint(1, 99)}", f"{r.choice(FIRST)}_{r.choice(LAST)}", "info", "office"])
    labels = [*r.choice([[], [], [r.choice(["mail", "team", "post"])]]), r.choice(HOSTS) + r.choice(["", "", str(r.randint(1, 9))]), *r.choice(TOPS).split(".")]
    at, dot = r.choice([(" at ", " dot "), ("(at)", "."), (" (at) ", "."), (" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", "."), ("@ ", "."), ("@", " dot "), ("@", "[.]"), (" @ ", " . "), ("@", "(dot)")])
    out = name + at + dot.join(labels)
    return out.upper() if r.random() < 0.1 else out


def ip(r: random.Random) -> str:
    return r.choice(["[.]", "(.)", " . ", "[.]"]).join(str(r.randint(1, 255)) for _ in range(4))


def card(r: random.Random) -> str:
    if r.random() < 0.4:
        number = check_digit(r.choice(["34", "37"]) + _digits(r, 12))
        return r.choice([number, _grouped(number, (4, 6), " "), _grouped(number, (4, 6), "-"), _grouped(number, (4, 6), ".")])
    number = check_digit(r.choice(["4", "51", "55", "60"]) + _digits(r, 14))[-16:]
    number = check_digit(number[:15])
    return _grouped(number, (4, 4, 4), r.choice([".", "  ", "/", ". ", "--"]))


def phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice(
        [
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"00{r.choice(['49', '33', '34', '44', '1'])} {a} {b}{c}", f"0{r.randint(20, 99)}/{b}{c}",
            f"0{a} {b} {c}", f"0{r.randint(1, 9)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}", f"(0{r.randint(20, 99)}) {b} {c}", f"0{a}-{b}{c}", f"0{a}/{b} {c}", f"{a} {b} {c}",
        ]
    )


def date(r: random.Random) -> str:
    y, m, d = r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28)
    return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d:02}/{m:02}/{y}", f"{y}/{m:02}/{d:02}", f"{y}{m:02}{d:02}", f"{y}-{m:02}-{d:02} {r.randint(10, 23)}", f"{y}{m:02}{d:02}{_digits(r, 6)}", f"{y}-{r.randint(1900, 2030)}"])


def amount(r: random.Random) -> str:
    head, groups = _digits(r, r.randint(1, 3)), [f"{r.randint(0, 999):03}" if r.random() < 0.5 else f"{r.randint(0, 9)}00" for _ in range(r.randint(2, 3))]
    return r.choice([" ", ",", ".", " "]).join([head, *groups]) + r.choice(["", "", ".50", ",00"])


def order(r: random.Random) -> str:
    number = _digits(r, r.choice([8, 9, 10, 10, 11, 12, 13, 14, 15, 15, 16, 18, 20]))
    return r.choice([number, number, _grouped(number, (2, 3, 3), " "), _grouped(number, (4, 4, 4), "-"), _grouped(number, (4, 6), "-"), _grouped(number, (3, 7), "-"), _grouped(number, (4, 4, 4), "."), _grouped(number, (5,), "/")])


def isbn(r: random.Random) -> str:
    number = r.choice(["978", "979"]) + _digits(r, 10) if r.random() < 0.7 else _digits(r, 10)
    return r.choice([number, _grouped(number, (3, 1, 5, 3), "-"), _grouped(number, (3, 1, 3, 5), "-"), _grouped(number, (3, 1, 5, 3), " ")] if len(number) == 13 else [number, _grouped(number, (1, 5, 3), "-"), _grouped(number, (1, 3, 5), " ")])


def listing(r: random.Random) -> str:
    return r.choice([", ", " ", "/"]).join(str(r.randint(1, r.choice([9, 40, 300]))) for _ in range(r.randint(6, 12)))


def section(r: random.Random) -> str:
    return r.choice([". ", " . "]).join(str(r.randint(1, 20)) for _ in range(4))


def prose(r: random.Random) -> str:
    tail = r.choice([f". {r.choice(NEXT)}", f". {r.choice(NEXT)}", f". {r.choice(NEXT).lower()}", f".{r.choice(NEXT)}", f" {r.randint(1, 12)}.{r.randint(0, 59):02}", " dot product", f" dot {r.choice(PLACES)}"])
    return f"{r.choice([r.choice(SUBJECTS) + ' ' + r.choice(VERBS), r.choice(VERBS)])} at {r.choice(PLACES)}{tail}"


def pointer(r: random.Random) -> str:
    return r.choice([f"at {r.choice(HOSTS)}.{r.choice(TOPS)}", f"@ {r.choice(PLACES)}. {r.choice(NEXT)}", f"at {r.choice(HOSTS)}.{r.choice(HOSTS)}"])


MAKERS = {
    "email": email, "ip": ip, "card": card, "phone": phone, "date": date, "amount": amount, "order": order, "isbn": isbn,
    "list": listing, "section": section, "prose": prose, "pointer": pointer,
}


def examples(seed: int = 11) -> list[tuple[bool, str, str, str]]:
    """(held out for calibration, text, kind of the planted string or "" if it is no personal data, the planted string)."""
    r, out = random.Random(seed), []
    for group, positive in ((POSITIVE, True), (NEGATIVE, False)):
        for kind, templates in group.items():
            for n, template in enumerate([*templates, *NEUTRAL]):
                for _ in range(FILLS):
                    planted = MAKERS[kind](r)
                    lead, tail = r.choice(["", "so ", "Note that ", "und ", "1. "]), r.choice(["", "", ".", " ok", ", and more"])
                    out.append((n % FOLDS == FOLDS - 1, lead + template.format(planted) + tail, kind if positive else "", planted))
    return out
