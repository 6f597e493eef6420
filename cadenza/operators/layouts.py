"""The four distributor report layouts and how columns are found in them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from cadenza.schema import RequestError


@dataclass(frozen=True)
class Layout:
    """Header aliases of one distributor. `mandatory` maps a field to the label
    its error message uses."""

    name: str
    mandatory: dict[str, str]
    aliases: dict[str, tuple[str, ...]]
    always_usd: bool = False


# Header aliases all four layouts share.
SHARED_ALIASES = {
    "upc": ("upc", "upc code", "barcode", "gtin", "ean", "album upc", "release upc", "ean/upc"),
    "artist": ("artist", "artist name", "band", "performer"),
    "album": ("album", "album title", "release", "release title", "project", "project title"),
    "territory": ("territory", "country", "country code", "region", "sale country"),
    "transaction_type": (
        "transaction type",
        "sale type",
        "type",
        "activity type",
        "stream type",
    ),
}

# Header aliases and error labels per layout.
DISTROKID = Layout(
    name="DistroKid",
    always_usd=True,
    mandatory={
        "isrc": "ISRC",
        "title": "Title",
        "platform": "Store",
        "reporting_date": "Reporting Month",
        "net_revenue": "Earnings",
    },
    aliases={
        "isrc": ("isrc", "isrc code"),
        "title": ("song title", "title", "track title"),
        "platform": ("store", "platform", "service", "shop"),
        "reporting_date": ("reporting month", "month", "date", "period"),
        "net_revenue": ("earnings (usd)", "earnings", "revenue", "amount", "net"),
        "quantity": ("quantity", "units", "streams", "stream count", "count"),
    },
)
TUNECORE = Layout(
    name="TuneCore",
    mandatory={
        "isrc": "ISRC",
        "title": "Title",
        "platform": "Store",
        "reporting_date": "Date",
        "net_revenue": "Earnings",
    },
    aliases={
        "isrc": ("isrc", "isrc code"),
        "title": ("song title", "title", "track", "track title"),
        "platform": ("store", "platform", "sales platform", "sales type"),
        "reporting_date": ("sales period", "reporting date", "date", "period", "posting date"),
        "net_revenue": ("total earned", "earnings", "revenue", "net revenue"),
        "currency": ("currency", "curr"),
        "quantity": ("quantity", "units", "streams", "stream count", "count"),
    },
)
CDBABY = Layout(
    name="CDBaby",
    mandatory={
        "isrc": "ISRC",
        "title": "Title",
        "platform": "Partner/Platform",
        "reporting_date": "Period",
        "net_revenue": "Payable/Earnings",
    },
    aliases={
        "isrc": ("isrc",),
        "title": ("track title", "song title", "title"),
        "platform": ("partner", "store", "platform"),
        "reporting_date": ("period", "accounting period", "date", "reporting period"),
        "net_revenue": ("payable", "net revenue", "earnings", "amount"),
        "currency": ("currency",),
        "quantity": ("quantity", "units"),
    },
)
SYMPHONIC = Layout(
    name="Symphonic",
    mandatory={
        "isrc": "ISRC",
        "title": "Title",
        "platform": "DSP/Platform",
        "reporting_date": "Date",
        "net_revenue": "Net Revenue",
    },
    aliases={
        "isrc": ("isrc",),
        "title": ("track title", "title"),
        "platform": ("dsp", "store", "platform"),
        "reporting_date": ("reporting month", "date", "month"),
        "net_revenue": ("net revenue", "earnings", "total"),
        "currency": ("currency",),
        "quantity": ("units", "quantity"),
    },
)
LAYOUTS = {layout.name: layout for layout in (DISTROKID, TUNECORE, CDBABY, SYMPHONIC)}


def find_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First file column whose name holds any alias; file order decides.

    Holding is enough: alias `count` finds `Country`. That is the rule the
    results must follow, so it is kept.
    """
    for name in columns:
        plain = name.lower().strip()
        if any(alias in plain for alias in aliases):
            return name
    return None


def resolve(columns: Sequence[str], layout: Layout) -> dict[str, str | None]:
    """File column per royalty field; a missing mandatory one refuses the file."""
    found = {
        field: find_column(columns, aliases)
        for field, aliases in {**SHARED_ALIASES, **layout.aliases}.items()
    }
    for field, label in layout.mandatory.items():
        if found[field] is None:
            raise RequestError(f"Missing {label} column in {layout.name} file")
    return found
