"""Labelled lines that the sequence model has not seen: other words, names and numbers."""

# Around a span; and what the span may be, by kind.
AROUND = [
    "the office can be found under {} since May", "if nobody answers try {} instead", "{} belongs to the new manager",
    "Bitte melden Sie sich unter {} bis Freitag", "on peut joindre le bureau au {} demain", "para mas datos {} o en persona",
    "questions? {} will help", "forwarded by {} yesterday", "they gave us {} and nothing else", "new: {} (old one is gone)",
]
SPANS = {
    "email": [
        "paula [at] garden [dot] net", "max (at) werk (dot) example", "olga dot ivanova at post dot example", "t.green (at) sample.net",
        "sales at shop dot example", "h.k.9 [at] lab.example.org", "rita(at)casa.es", "info [at] klinik.example", "joe_b (at) mail (dot) example",
        "anna dot lind at sample dot net",
    ],
    "phone": [
        "call 415 555 0177", "phone (212) 555-0188", "tel. 0171 555 0199", "cell 555 0123", "phone 020 7946 0777", "fax 632.555.0166",
        "mobile 0160 5550111", "call 1-888-555-0122", "Tel 030 555 01 88", "number 555-0145",
    ],
    "ip": ["host 10.20.30.40", "server 172.16.254.3"],
    "card": ["card 4000.0566.5566.5556", "card 3056 930902 5904"],
}
CLEAN = [
    "the house at the corner is for sale", "he looked at it and put a dot on the line", "we met at nine and left at 11",
    "pages 12 to 48 of volume 3", "it was built in 1887 and burnt in 1923", "about 2,300 people live at the lake",
    "the answer is 42, or 43 at most", "version 3.10.2 runs on 64 bits", "from 10 to 12 at the town hall", "chapter 7 section 3 page 120",
    "a table of 8 by 10 with 80 cells", "at noon the bells rang 12 times", "order 99127 of 2021 was late", "on 14 July 1789 at Paris",
    "the call came at 5 and again at 6", "the card game had 52 cards and 2 jokers", "mail takes 3 to 5 days", "write 100 lines by Monday",
    "the desk is 140 by 70", "his number is 23 and hers 7", "dot your i and cross your t at last", "at 20 he was a king",
    "scores of 88, 91 and 95 were seen", "0.5 of 12 is 6", "room 212 of the 555 block", "the 1984 edition has 328 pages",
    "temperatures of 21.5 to 23.0 at sea", "the ratio 3:2 or 16:10", "isbn 3-16-148410-0 of the book", "it rained 12 of 14 days",
]


def lines():
    """``(text, spans)``, each kind in each of the sentences."""
    made = [(text, []) for text in CLEAN]
    for turn, (kind, spans) in enumerate(SPANS.items()):
        for i, span in enumerate(spans):
            for j in (i, i + 3 + turn):
                text = AROUND[j % len(AROUND)].format("\0").replace("\0", span)
                word = span.split(" ", 1)
                own = span if kind == "email" else word[1]
                start = text.index(own)
                made.append((text, [(kind, start, start + len(own))]))
    return made
