"""The spans of all contract patterns in ASCII texts, found from literal keys, one Arrow batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import patterns as P


def scanner(ranks: tuple[int, ...], keep: bool = False, whole: bool = False):
    """A function over batches of (doc_id, t, ...) that adds ``spans``, equal to ``patterns.spans_in(t, ranks)``; null where ``t`` is not
    ASCII or holds a NUL, but with ``whole`` no text is left out: such a one is searched by itself, by Unicode's rules. With ``keep``
    it also adds ``kept``, the places of the spans that ``patterns.drop_overlaps`` leaves, null for texts not of ASCII.

    Texts are cut where no match can stand, and of the parts that are equal in a batch, as contracts share much of their wording,
    one is searched. Parts are joined by NULs, which no pattern reaches over, and put to lower case, in which patterns that
    are blind to case are matched: offsets stay, and a match is looked for only where a literal that it must hold stands (or
    a digit), which C code finds. What it returns is carried to workers by value, so that they need not import the package.
    """
    title = {rank: (name, group) for name, rank, _, group in P.PATTERNS}
    regexes = {rank: re.sub(r"^\(\?\w+\)", "", regex) for _, rank, regex, _ in P.PATTERNS}
    regexes = {rank: r if rank == 1 else r.lower() for rank, r in regexes.items()}
    regexes[0] = regexes[0].replace('[^"]', '[^"\\0]').replace("(.+?)", "([^\\n\\0]+?)").replace("|$)", "|$|(?=\\0))")
    compiled = {rank: re.compile(r, re.ASCII | re.MULTILINE) for rank, r in regexes.items()}
    blank, word, run = " \t\n\r\f\v", "abcdefghijklmnopqrstuvwxyz0123456789_", "abcdefghijklmnopqrstuvwxyz \t\n\r\f\v&.,"

    class Joined:
        """Joined texts, as they are and in lower case, whose codes stand beside them, alone and with the code that follows."""

        def __init__(self, whole: str):
            self.whole, self.text = whole, whole.lower()
            self.codes = np.frombuffer(self.text.encode(), np.uint8)
            self.pairs = self.codes[:-1] + self.codes[1:] * np.uint16(256)

    def places(low: Joined, keys: tuple[str, ...], back: int = 0) -> list[int]:
        """Where any of the keys stands, less ``back``, in order: their first two characters are compared for all places at once."""
        found = []
        for key in keys:
            hits = np.flatnonzero(low.pairs == ord(key[0]) + 256 * ord(key[1])) if len(key) > 1 else np.flatnonzero(low.codes == ord(key))
            found += [at - back for at in hits.tolist() if low.text.startswith(key, at)] if len(key) > 2 else (hits - back).tolist()
        found.sort()
        return found

    def at_keys(regex, *keys):
        """Next match at or after a place, of those that begin so many characters before a key; places asked for never fall."""

        def begin(low):
            left = iter(sorted({at for names, back in keys for at in places(low, names, back) if at >= 0}))

            def search(pos):
                for at in left:
                    if at >= pos and (m := regex.match(low.text, at)):
                        return m
                return None

            return search

        return begin

    def before_keys(regex, keys, chars):
        """Next match that ends with a key, of those whose part before the key is of some characters."""

        def begin(low):
            left, text = places(low, keys)[::-1], low.text

            def search(pos):
                while left:
                    at = left[-1]  # stays there when found: another's match may take the head of this one
                    if at >= pos:
                        m = regex.search(text, pos + len(text[pos:at].rstrip(chars)), at + 8)
                        if m and m.start() < at:
                            return m
                        pos = at
                    left.pop()
                return None

            return search

        return begin

    def leftmost(*parts):
        """The matches of alternatives side by side: the leftmost first, the others from its end."""

        def find(low):
            searches = [begin(low) for begin in parts]
            found = [search(0) for search in searches]
            while any(found):
                m = min((x for x in found if x), key=lambda x: x.start())
                yield m
                end = m.end()
                found = [x if x is None or x.start() >= end else search(end) for x, search in zip(found, searches)]

        return find

    def in_runs(regex, keys, tail):
        """Matches that begin at the head of a run of letters, in runs where a key with its tail stands or which one ends."""
        tail = re.compile(tail, re.ASCII)

        def find(low):
            end, before, fresh, text = 0, 0, True, low.text
            for at in places(low, keys):
                if at < end or not tail.match(text, at):
                    continue
                piece = text[before:at].rstrip(run)
                if piece or fresh:
                    if m := regex.match(text, before + len(piece)):
                        yield m
                        end, before, fresh = m.end(), m.end(), True
                        continue
                before, fresh = at, False

        return find

    digits = "0123456789"
    number = re.compile(r"\d\d*\)?\s*(?:days?|months?|years?|weeks?|business\s+days?)", re.ASCII)

    def durations(low):
        """Numbers with a unit; a match begins earlier where a word stands before the number's bracket, or where the number's own
        word stands before another one's."""
        end, before, text = 0, 0, low.text
        for unit in places(low, ("day", "month", "year", "week")):
            if unit < end:
                continue
            before, since = unit, max(before, end)
            piece = text[since:unit].rstrip(blank)
            found = number.search(text, since + len(piece.removesuffix("business").rstrip(digits + ")" + blank)), unit + 6)
            if found is None or found.start() >= unit:
                continue
            at, m = found.start(), None
            if at > end and text[at - 1] == "(":
                piece = text[end : at - 1].rstrip(blank)
                head = len(piece.rstrip(word))
                if head < len(piece) < at - 1 - end:
                    m = compiled[3].match(text, end + head)
            if m is None:
                m = compiled[3].match(text, end + len(text[end:at].rstrip(word))) or compiled[3].match(text, at)
            yield m
            end = m.end()

    amount = re.compile(r"[\d,][\d,]*(?:\.\d{1,2})?\s*(?:usd|eur|gbp|inr|dollars?|pounds?|euros?)", re.ASCII)
    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    currencies = ("usd", "eur", "gbp", "inr")
    finders = {
        0: lambda low: compiled[0].finditer(low.text),
        1: lambda low: compiled[1].finditer(low.whole),
        2: leftmost(at_keys(compiled[2], (("section", "clause", "article", "appendix", "schedule", "annex"), 0))),
        3: durations,
        4: leftmost(at_keys(compiled[4], (("$", *currencies), 0)), before_keys(amount, (*currencies, "dollar", "pound"), digits + ",." + blank)),
        5: leftmost(at_keys(compiled[5], (months, 0), (("/",), 2), (("/",), 1), (("-",), 4))),
        6: leftmost(before_keys(compiled[6], ("%",), digits + "." + blank)),
        7: in_runs(compiled[7], ("hereinafter", "hereafter", "("), regexes[7].split(r",?\s*", 1)[1]),
        8: in_runs(compiled[8], ("corporation", "company", "partnership", "entity", "limited"), "(?:corporation" + regexes[8].split("(?:corporation", 1)[1]),
    }
    groups = {0: (1, 2), 1: (1, 2), 2: (1,), 3: (2, 3), 7: (1, 2), 8: (1, 2)}
    wanted = [(rank, title[rank][1], groups.get(rank, ()), finders[rank]) for rank in sorted(ranks)]
    names = [title[rank][0] for rank in range(len(P.PATTERNS))]
    i32, string = pa.int32(), pa.string()
    marks = str.maketrans("\ufdd0\ufdd1", "\ufffd\ufffd")
    unicode = []
    for rank in sorted(ranks):
        regex = P.PATTERNS[rank][2]
        body, flags = P.in_python(P.FAST.get(regex, regex)), regex[: regex.index(")")]
        flags = re.IGNORECASE * ("i" in flags) | re.MULTILINE * ("m" in flags)
        # where the last match ended a word's head need not stand
        unicode.append((rank, title[rank][1], groups.get(rank, ()), re.compile(body.replace(r"|\G", ""), flags), re.compile(body.replace(r"(?:(?<!\w)|\G)", ""), flags) if r"\G" in body else None))

    def alone(text: str) -> list[tuple]:
        """The spans of one text of any characters, in order."""
        text, out = text.translate(marks), []
        for rank, group, shown, regex, at_end in unicode:
            pos, i = 0, 0
            while m := (at_end and at_end.match(text, pos)) or regex.search(text, pos):
                said = [m[g] or "" for g in shown]
                said = [x.strip(" ") if rank in (1, 7, 8) or k and rank == 0 else x for k, x in enumerate(said)]
                start, value = m.start(), said[0] if group else m[0]
                if rank >= 7:
                    value = value.lstrip(" \t\n\r\f\v&.,")
                    start = m.end() - len(value)
                if rank == 1:
                    out += [(start, rank, i * 2 + k, m.end(), names[rank], x, x, None) for k, x in enumerate(said) if x or not k]
                else:
                    out.append((start, rank, i, m.end(), names[rank], value, *said, *[None] * (2 - len(said))))
                pos, i = m.end(), i + 1
        return sorted(out, key=lambda s: s[:3])

    def left_over(text, start, stop, rank) -> np.ndarray:
        """Which of the spans, in order, are left when overlaps are dropped; only where a span overlaps the one before it is looked at."""
        title = np.where(rank == 1, 0, np.where(rank == 8, 7, rank))
        left = np.ones(len(text), bool)
        near = np.flatnonzero((text[1:] == text[:-1]) & (title[1:] == title[:-1]) & (start[1:] < stop[:-1])) + 1
        done, texts, starts, stops, titles = 0, *(x.tolist() for x in (text, start, stop, title))
        for at in near.tolist():
            last, i = at - 1, max(at, done)
            while at >= done and (i == at or last < i - 1) and i < len(texts) and texts[i] == texts[last]:
                if starts[i] >= stops[last] or titles[i] != titles[last]:
                    last = i
                elif stops[i] - starts[i] > stops[last] - starts[last]:
                    left[last], last = False, i
                else:
                    left[i] = False
                i += 1
            done = i
        return left

    def spans(whole: str, begins: np.ndarray):
        """The spans of joined texts, of which each begins at one of ``begins``: how many each text has, and all in order."""
        low, parts, values = Joined(whole), [], [[], [], []]
        for rank, group, shown, find in wanted:
            found = list(find(low))
            if not found:
                continue
            start, stop = np.array([m.span() for m in found]).T
            text = np.searchsorted(begins, start, "right") - 1
            n = np.arange(len(found)) - np.searchsorted(text, text)  # the how many-th of its text
            said = [[whole[i:j] if i >= 0 else "" for i, j in (m.span(g) for m in found)] for g in shown]
            if rank == 1:
                said = [[x.strip(" ") for x in column] for column in said]
                second = np.flatnonzero([x != "" for x in said[1]])
                said[0] += [said[1][i] for i in second]
                start, stop, text, n = (np.concatenate([x, y[second]]) for x, y in ((start, start), (stop, stop), (text, text), (n * 2, n * 2 + 1)))
                said[1] = [None] * len(start)
            elif rank >= 7:
                start = start + [len(v) - len(v.lstrip(" \t\n\r\f\v&.,")) for v in (m.group() for m in found)]
                said = [[x.strip(" ") for x in column] for column in said]
            elif rank == 0:
                said[1] = [x.strip(" ") for x in said[1]]
            value = said[0] if group else [whole[i:j] for i, j in zip(start.tolist(), stop.tolist())]
            said += [[None] * len(start)] * (2 - len(said))
            for column, more in zip(values, (value, *said)):
                column += more
            parts.append(np.stack([text, start - begins[text], np.full(len(start), rank), n, stop - begins[text]]))
        text, start, rank, n, stop = np.concatenate(parts, 1) if parts else np.empty((5, 0), int)
        order = np.lexsort((n, rank, start, text))
        place = [pa.array(x[order], i32) for x in (start, rank, n, stop)]
        said = [pa.array(column, string).take(pa.array(order)) for column in values]
        left = pa.array(left_over(text[order], start[order], stop[order], rank[order]))
        held = pa.StructArray.from_arrays([*place, pa.array(names, string).take(place[1]), *said, left], names=["start", "rank", "n", "stop", "pattern", "value", "a", "b", "left"])
        return np.bincount(text, minlength=len(begins)), held

    def parts_of(whole: str, begins: np.ndarray) -> np.ndarray:
        """Where joined texts begin and where they may be cut, so that each part has the same matches alone as in its text.

        That is between a stop with a line feed and a digit: names hold no digit, and no other pattern but the first holds a stop
        and a blank. A definition's term may hold both, but is closed by a quote before a blank: a text in which the
        first quote of a later part stands so is left whole.
        """
        codes = np.frombuffer(whole.encode(), np.uint8)
        at = np.flatnonzero(codes[1:-1] == 10) + 1
        at = at[(codes[at - 1] == 46) & (codes[at + 1] - np.uint8(48) < 10)] + 1
        quotes = np.append(np.flatnonzero(codes == 34), len(codes))
        first = quotes[np.searchsorted(quotes, at)]
        after = codes[np.minimum(first + 1, len(codes) - 1)]
        closes = (first < np.append(at[1:], len(codes))) & ((after == 32) | (after - np.uint8(9) < 5))
        text = np.searchsorted(begins, at, "right") - 1
        return np.sort(np.append(begins, at[~np.isin(text, text[closes])]))

    def held_in(texts: list[str]):
        """What ``spans`` gives, from parts of the texts, of which equal ones are searched once."""
        begins = np.cumsum([0, *[len(x) + 1 for x in texts[:-1]]])
        whole = "\0".join(texts)
        at = parts_of(whole, begins)
        text = np.searchsorted(begins, at, "right") - 1
        ends = np.append(at[1:], len(whole) + 1)
        ends -= np.append(text[1:] != text[:-1], True)  # without the NUL
        seen: dict[str, int] = {}
        which = np.array([seen.setdefault(whole[i:j], len(seen)) for i, j in zip(at.tolist(), ends.tolist())])
        parts, lengths = list(seen), np.cumsum([len(x) + 1 for x in seen])
        sizes, found, done = [], [], 0
        while done < len(parts):
            upto = max(done + 1, int(np.searchsorted(lengths, (lengths[done - 1] if done else 0) + 300_000, "right")))
            some = parts[done:upto]
            n, held = spans("\0".join(some), np.cumsum([0, *[len(x) + 1 for x in some[:-1]]]))
            sizes.append(n)
            found.append(held)
            done = upto
        sizes, found = np.concatenate(sizes), pa.concat_arrays(found)
        # each part's spans again at every place where it stands
        per, owner = sizes[which], np.repeat(np.arange(len(at)), sizes[which])
        before = np.cumsum(per) - per
        rows = (np.cumsum(sizes) - sizes)[which][owner] + np.arange(len(owner)) - before[owner]
        taken = dict(zip((f.name for f in found.type), found.take(pa.array(rows)).flatten()))
        start, rank, n, stop = (taken[c].to_numpy() for c in ("start", "rank", "n", "stop"))
        shift, doc = (at - begins[text])[owner], text[owner]
        again = np.zeros(len(owner), np.int64)  # matches of the pattern in the text's parts before
        for r in np.unique(rank):
            mine = np.flatnonzero(rank == r)
            many = np.bincount(owner[mine], n[mine] % 2 == 0 if r == 1 else None, minlength=len(at)).astype(np.int64) * (2 if r == 1 else 1)
            total = np.cumsum(many) - many
            again[mine] = (total - total[np.searchsorted(text, text)])[owner[mine]]
        taken |= {name: pa.array(x, i32) for name, x in (("start", start + shift), ("n", n + again), ("stop", stop + shift))}
        left = taken.pop("left").to_numpy(zero_copy_only=False)
        return np.bincount(doc, minlength=len(texts)), pa.StructArray.from_arrays(list(taken.values()), names=list(taken)), doc, left

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["t"].to_pylist()
            lengths, at = np.cumsum([len(x) if x else 0 for x in texts]), 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + 16_000_000, "right")))
                part, some = batch.slice(at, upto - at), texts[at:upto]
                known = np.array([x is None or x.isascii() and "\0" not in x for x in some])
                sizes, held, doc, left = held_in([x if k and x else "" for x, k in zip(some, known)])
                if whole and not known.all():
                    others = [(k, s) for k in np.flatnonzero(~known).tolist() for s in alone(some[k])]
                    columns = [pa.array([s[i] for _, s in others], kind) for i, kind in enumerate((i32,) * 4 + (string,) * 4)]
                    doc = np.concatenate([doc, np.array([k for k, _ in others], int)])
                    order = np.argsort(doc, kind="stable")
                    held = pa.concat_arrays([held, pa.StructArray.from_arrays(columns, names=["start", "rank", "n", "stop", "pattern", "value", "a", "b"])]).take(pa.array(order))
                    doc, left = doc[order], np.append(left, np.zeros(len(others), bool))[order]
                    sizes = np.bincount(doc, minlength=len(some))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                offsets = pa.array(ends, i32, mask=np.append(~known & (not whole), False))
                columns = {**{name: part[name] for name in part.schema.names}, "spans": pa.ListArray.from_arrays(offsets, held)}
                if keep:
                    begin = np.concatenate([[0], np.cumsum(np.bincount(doc[left], minlength=len(some)))])
                    places = (np.arange(len(doc)) - ends[doc])[left]
                    columns["kept"] = pa.ListArray.from_arrays(pa.array(begin, i32, mask=np.append(~known, False)), pa.array(places, i32))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                at = upto

    scan.parts_of = parts_of
    return scan
