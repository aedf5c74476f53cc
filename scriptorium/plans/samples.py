"""Small files and questions for judging chunking strategies; texts are our own."""

from __future__ import annotations

SERVICE = '''import math

GAP = 0.25


def shelf_of(year: int):
    """The shelf and side of a year's box."""
    shelf, place = divmod(year, 10)
    side = "left" if place < 5 else "right"
    where = f"{shelf}-{side}"
    return where


def total_width(boxes: list):
    """Whole centimetres that boxes take."""
    width = 0.0
    for box in boxes:
        width += box.width
        width += GAP
    return math.ceil(width)


class Shelf:
    """A row of boxes."""
    boxes = ()
'''

GUIDE = """# Archive guide

## Why boxes

Boxes keep the papers of one year together and are easy to move.

## How to label

Write the year first, then the office, then a running number.

## Where to put them

Shelves are filled from the left; the lowest shelf stays free.
"""

SETTINGS = """[server]
host = archive.example.org
port = 8080
mode = quiet

[worker]
retries = 12
"""

HANDBOOK = """# Reading room handbook

## Part one: visits

### Opening hours

The reading room opens at nine and closes at five on working days.
Lunch is from twelve to one, when no papers are fetched.
Visitors may stay for eight hours a day at most.

### Late returns

Papers are returned by half past four on the same day.
A third late return in a month ends the visit.

## Part two: costs

### Copies

A page costs twenty cents, and fifty pages are free each year.
Large sheets cost two euros.
Colour costs twice as much as grey.
Bound volumes are never copied whole.
Invoices are sent at the end of a month.
Orders from abroad are paid beforehand and take three weeks.

### Supplies

Pencils and gloves are given out at the desk.
Cameras must be named to the staff on arrival.

## Part three: absence

### Holidays

The room is closed on public holidays and in the last week of a year.
Two weeks in summer are kept for stocktaking.

### Illness

A visit that is missed by illness may be booked again.
A note is needed after the second time.
"""

#: (id, question, path, source_text, first and last expected line, family, failure_mode)
CASES = [
    ("shelf_of", "On which shelf is a year?", "service.py", SERVICE, 6, 11, "code_symbol", "signature apart from body"),
    ("total_width", "How wide are boxes together?", "service.py", SERVICE, 14, 20, "code_symbol", "signature apart from the sum"),
    ("shelf_class", "What is a shelf?", "service.py", SERVICE, 23, 25, "code_symbol", "class apart from its body"),
    ("gap_constant", "How wide is a gap?", "service.py", SERVICE, 3, 3, "code_config", "constant lost in a large chunk"),
    ("why_boxes", "Why are boxes used?", "guide.md", GUIDE, 3, 5, "doc_section", "heading apart from its text"),
    ("how_to_label", "How are boxes labelled?", "guide.md", GUIDE, 7, 9, "doc_section", "two sections in one chunk"),
    ("host_setting", "Which host is it?", "app.ini", SETTINGS, 2, 2, "code_config", "key apart from its section"),
    ("worker_retries", "How many retries has the worker?", "app.ini", SETTINGS, 7, 7, "code_config", "key apart from its section"),
    ("late_returns", "What if papers are late?", "handbook.md", HANDBOOK, 11, 14, "doc_section", "heading apart from its text"),
    ("copies", "What does a page cost?", "handbook.md", HANDBOOK, 18, 20, "doc_section", "heading apart from its text"),
    ("holidays", "When is the room closed?", "handbook.md", HANDBOOK, 34, 37, "doc_section", "section cut in two"),
]

#: Files of which some are refused: (path, size).
FILES = [
    ("docs/.env", 20), ("docs/.env.local", 20), ("docs/server.key", 400), ("docs/notes.PEM", 400), ("docs/credentials.md", 90), ("docs/Secret-plan.md", 90), ("docs/my_secret.md", 90),
    ("docs/id_rsa", 900), ("docs/deploy_RSA", 900), ("docs/a.md", 10), ("docs/B.MARKDOWN", 10), ("docs/empty.md", 0), ("docs/large.md", 3_000_000), ("docs/edge.md", 2_097_152),
    ("docs/readme.txt", 10), ("docs/archive.tar.md", 10), ("docs/noext", 10), ("docs/sub/.md", 10), ("docs/sub/x.kdbx", 10), ("docs/sub/dot.", 10),
]
