"""Sentences labelled by hand, for the model that finds personal data: [kind|span] marks a span.

They are of other wording and other forms than the generator that the model is trained on.
"""

import re

SENTENCES = [
    "Please send the minutes to [email|margaret.olsen@fjordpost.no] before Friday.",
    "You can reach our office in Lyon at [phone|+33 4 72 00 15 93], or write to [email|contact@atelier-rhone.fr].",
    "The server at [ip|192.168.14.203] did not answer after 3 attempts on 12 May 2019.",
    "My card, [card|4556 7375 8689 9855], expires in 09/27 and I need a new one.",
    "Call me back on [phone|(415) 555-0134] when you get this; I'm home after 18:30.",
    "In 1998 the village had 2,314 inhabitants, of whom 1,120 worked in the mill.",
    "Her new address is [email|j_fairweather77@mailhaven.org]; the old one bounces.",
    "Version 2.14.3 of the parser was released on 2021-11-04 and fixes 37 bugs.",
    "Bitte rufen Sie uns unter [phone|+49 (30) 901-82031] an oder schreiben Sie an [email|post@rathaus-mitte.de].",
    "Traffic came mostly from [ip|10.0.45.7] and [ip|172.16.254.1], which belong to the lab.",
    "Invoice #20931 over 1,499.00 EUR was paid on 3/14/2022 by bank transfer.",
    "Llame al [phone|+34 915 55 01 22] para reservar; abrimos de 9:00 a 17:00.",
    "The chapter on page 214 cites 12 sources, among them a letter of 1743.",
    "He typed [card|5500-0000-0000-0004] into the form twice and was charged twice.",
    "Escríbeme a [email|lucia.navarro_88@correo-sur.es] y te mando las fotos.",
    "Set the gateway to [ip|81.2.69.160] and the port to 8080, then restart.",
    "The ratio was 3.14159 in the first run and 2.71828 in the second.",
    "Questions? [email|help-desk@library.uni-quito.edu.ec] answers within 24 hours.",
    "Tracking number 1Z 999 AA1 01 2345 6784 was delivered at 14:05.",
    "Rufnummer: [phone|+43 1 58858 0120], Durchwahl 14.",
    "Ping [ip|203.0.113.45] first; if it is down try [ip|198.51.100.7].",
    "The train leaves at 07:42 from platform 9 and arrives at 11:15.",
    "Use the test card [card|378282246310005] for the demo, it is never billed.",
    "Office: [phone|212-555-0187]. Fax is no longer in use since 2015.",
    "Follow @harbourlights for news, or mail [email|news@harbour.lights.io].",
    "Section 4.2.1 requires at least 16 characters, of which 2 must be digits.",
    "Dr. Weiss ([email|a.weiss@klinik-nord.de], [phone|+49 40 7410 0]) is on leave until the 14th.",
    "The ISBN 978-3-16-148410-0 was assigned to the second edition.",
    "I paid with [card|6011 1111 1111 1117] on the 5th and again on the 9th.",
    "Results: 0.83, 0.79, 0.91 and 0.88 over 4 folds of 250 rows.",
    "For press requests dial [phone|+1 (646) 555-0199] or visit room 1204.",
    "log: accepted connection from [ip|93.184.216.34] port 51512 ssh2",
    "The recipe needs 250 g of flour, 3 eggs and 1/2 l of milk.",
    "Je suis joignable au [phone|+33.6.12.34.56.78] tous les jours sauf le 25.",
    "The meeting id is 845 221 907 and the passcode is 4411.",
    "Someone at [email|finance.dept@northwind-traders.co.uk] signed it in 2003.",
]

_MARK = re.compile(r"\[(email|ip|card|phone)\|([^\]]+)\]")


def labelled() -> list[tuple[str, set[tuple[str, int, int]]]]:
    """(text, spans) of each sentence."""
    out = []
    for s in SENTENCES:
        text, spans, at = "", set(), 0
        for m in _MARK.finditer(s):
            text += s[at : m.start()]
            spans.add((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        out.append((text + s[at:], spans))
    return out
