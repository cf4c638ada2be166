"""The inbound cap and the orphan guarantee as one goes through them: what the tests compare with."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import pandas as pd


def capped(links: pd.DataFrame, cap: int, exempt: set) -> pd.Series:
    """Which links are suggested once no page but the exempt ones takes more than ``cap``: best first, an overflow moves to its source's first reserve with room."""
    suggested = links["suggested"].to_numpy(dtype=bool, copy=True)
    if cap == 0:
        return pd.Series(suggested, index=links.index)
    source, target = links["source"].to_numpy(), links["target"].to_numpy()
    own = defaultdict(list)
    for i in links.reset_index(drop=True).sort_values(["source", "place"]).index:
        own[source[i]].append(i)
    room = Counter()
    queue = links.reset_index(drop=True).sort_values(["percentile", "source", "place", "target"], ascending=[False, True, True, True]).index
    for i in queue[suggested[queue]]:
        choice = i
        if target[i] not in exempt and room[target[i]] >= cap:
            suggested[i] = False
            choice = next((j for j in own[source[i]] if not suggested[j] and (target[j] in exempt or room[target[j]] < cap)), None)
        if choice is not None:
            suggested[choice] = True
            room[target[choice]] += 1
    return pd.Series(suggested, index=links.index)


def guaranteed(links: pd.DataFrame, pairs: pd.DataFrame, wanted: list, guarantee: int, limit: int) -> tuple[pd.DataFrame, dict]:
    """Links (source, target, rank_in_source, suggested, orphan_slot) with a slot for pages short of links, and why a page stays short.

    ``pairs`` are the tier 1 and 2 pairs into wanted pages (source, target, rank_in_source, percentile, strength, anchored).
    Pages with the fewest sources to ask go first. A source gives one slot, taking back its lowest suggestion into a page
    that is not wanted; a slot beyond its ``limit`` links drops its lowest reserve.
    """
    wish = set(wanted)
    book = {s: {t: [r, sug, False] for t, r, sug in g[["target", "rank_in_source", "suggested"]].itertuples(index=False)} for s, g in links.groupby("source")}
    inbound = Counter(t for s in book.values() for t, (_, sug, _) in s.items() if sug)
    gives = {s for s, own in book.items() if any(sug and t not in wish for t, (_, sug, _) in own.items())}
    offers = defaultdict(list)
    for s, t, r, p, st in pairs.loc[pairs["anchored"] & pairs["source"].isin(gives), ["source", "target", "rank_in_source", "percentile", "strength"]].itertuples(index=False):
        heapq.heappush(offers[t], (-p, -st, s, r))
    ask = lambda t: sum(not book[s].get(t, (0, False))[1] for *_, s, _ in offers[t])
    used = set()
    for t in sorted(wanted, key=lambda t: (ask(t), t)):
        while offers[t] and inbound[t] < guarantee:
            *_, s, rank = heapq.heappop(offers[t])
            own = book[s]
            if s in used or own.get(t, (0, False))[1]:
                continue
            used.add(s)
            lost = max((x for x in own if own[x][1] and x not in wish), key=lambda x: own[x][0])
            own[lost][1] = False
            inbound[lost] -= 1
            own.setdefault(t, [rank, True, True])[1:] = [True, True]
            inbound[t] += 1
            if len(own) > limit:
                del own[max((x for x in own if not own[x][1]), key=lambda x: own[x][0])]
    rows = [(s, t, r, sug, slot) for s, own in book.items() for t, (r, sug, slot) in own.items()]
    relevant, with_anchor = set(pairs["target"]), set(pairs.loc[pairs["anchored"], "target"])
    why = {t: "NO_RELEVANT_SOURCE" if t not in relevant else "NO_ANCHOR" if t not in with_anchor else "SOURCES_FULL" for t in wanted if inbound[t] < guarantee}
    return pd.DataFrame(rows, columns=["source", "target", "rank_in_source", "suggested", "orphan_slot"]), why
