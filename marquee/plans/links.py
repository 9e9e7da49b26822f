"""Searches as the query strings of shared links, under the names that links use."""

from __future__ import annotations

import math
import re
from urllib.parse import parse_qsl, urlencode

from marquee.plans.spec import FilterSpec, _is_date

# Names of axes and switches in links, and which tab has which.
FACET_PARAM = {"cats": "cats", "statuses": "status", "genres": "genre", "screeningTypes": "screen", "liveTypes": "ltype"}
FLAG_PARAM = {"dealsOnly": "deals", "newOnly": "new", "onsaleOnly": "onsale", "beforeOnly": "before", "limitedOnly": "limited", "favOnly": "fav"}
TAB_FACETS = {"event": ["cats", "statuses"], "movie": ["genres", "screeningTypes", "statuses"], "live": ["genres", "liveTypes", "statuses"]}
TAB_FLAGS = {"event": ["dealsOnly", "newOnly", "onsaleOnly", "beforeOnly", "limitedOnly", "favOnly"], "movie": ["dealsOnly", "newOnly", "onsaleOnly", "beforeOnly", "limitedOnly", "favOnly"], "live": ["newOnly", "onsaleOnly", "beforeOnly", "limitedOnly", "favOnly"]}


def to_link(tab: str, spec: FilterSpec) -> str:
    """The canonical query string of a search in a tab: equal searches have equal ones. Of circle, venue and prefecture the first one is written; a sort by place
    isn't, as another device stands elsewhere."""
    parts = [("tab", "" if tab == "event" else tab), ("q", spec.query)]
    if spec.start and spec.end:
        parts += [("from", str(spec.start)), ("to", str(spec.end))]
    if spec.area:
        parts.append(("map", "{:.5f},{:.5f},{:.2f}".format(*spec.area)))
    elif spec.venue:
        parts.append(("venue", spec.venue))
    else:
        parts.append(("pref", spec.pref or ""))
    parts += [(FACET_PARAM[f], ",".join(sorted(spec.facets.get(f, ())))) for f in TAB_FACETS[tab]]
    parts += [("f", ",".join(FLAG_PARAM[f] for f in TAB_FLAGS[tab] if f in spec.flags)), ("sort", "new" if spec.sort == "announced" else "")]
    return urlencode([(k, v) for k, v in parts if v])


def from_link(query: str) -> tuple[str, FilterSpec] | None:
    """(tab, search) of a query string; None if it has no part. What can't be read is left out."""
    pairs = parse_qsl(query.removeprefix("?"), keep_blank_values=True)
    if not pairs:
        return None
    got: dict[str, str] = {}
    for k, v in pairs:
        got.setdefault(k, v)
    tab = got.get("tab") if got.get("tab") in TAB_FACETS else "event"
    items = lambda name: [x.strip() for x in got.get(name, "").split(",") if x.strip()]
    a, b = got.get("from", ""), got.get("to", "")
    range_ = sorted((a, b)) if all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) and _is_date(x) for x in (a, b)) else None
    day = lambda i: None if range_ is None else FilterSpec.decode(f"from={range_[i]}").start
    try:
        circle = tuple(float(x) for x in got.get("map", "").split(",")[:3])
    except ValueError:
        circle = ()
    area = circle if len(circle) == 3 and all(map(math.isfinite, circle)) and circle[2] > 0 else None
    venue = None if area else got.get("venue") or None
    facets = {f: tuple(dict.fromkeys(items(FACET_PARAM[f]))) for f in TAB_FACETS[tab] if items(FACET_PARAM[f])}
    flags = {f for f in TAB_FLAGS[tab] if {f, FLAG_PARAM[f]} & set(items("f"))}
    if "onsaleOnly" in flags:
        flags.discard("beforeOnly")
    pref = None if area or venue else got.get("pref") or None
    return tab, FilterSpec(got.get("q", ""), facets, frozenset(flags), day(0), day(1), venue, area, pref, "announced" if got.get("sort") == "new" else "date")
