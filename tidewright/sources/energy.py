"""Load of a bidding zone from the public transparency platform for electricity: requests, XML answers, and the text that download() keeps."""

from __future__ import annotations

import datetime as dt
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

from tidewright.sources.weather import get

# The address, the document's type (total load) and its processes, and the codes of some zones.
ADDRESS = "https://web-api.tp.entsoe.eu/api"
DOCUMENT = "A65"
PROCESSES = {"Forecasted Load": "A01", "Actual Load": "A16"}
ZONES = {"AT": "10YAT-APG------L", "BE": "10YBE----------2", "CH": "10YCH-SWISSGRIDZ", "DE_LU": "10Y1001A1001A82H", "ES": "10YES-REE------0", "FR": "10YFR-RTE------C", "NL": "10YNL----------L", "PL": "10YPL-AREA-----S", "PT": "10YPT-REN------W"}


class NoData(ValueError):
    """The service has nothing for the time asked for."""


def _minutes(resolution: str) -> int:
    m = re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?", resolution)
    if not m or not (m[1] or m[2]):
        raise ValueError(f"{resolution!r} is no resolution")
    return 60 * int(m[1] or 0) + int(m[2] or 0)


def points(text: str) -> dict[dt.datetime, float]:
    """The values of an answer by time in UTC. A position that is left out repeats the one before it, up to the period's end."""
    root = ET.fromstring(text)
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
    if root.tag.startswith("Acknowledgement"):
        raise NoData(root.findtext(".//Reason/text") or "no data")
    out = {}
    for period in root.iter("Period"):
        at = lambda name, p=period: dt.datetime.strptime(p.findtext(f"timeInterval/{name}"), "%Y-%m-%dT%H:%MZ")
        step = dt.timedelta(minutes=_minutes(period.findtext("resolution")))
        known = {int(p.findtext("position")): float(p.findtext("quantity")) for p in period.iter("Point")}
        value = None
        for i in range((at("end") - at("start")) // step):
            value = known.get(i + 1, value)
            if value is not None:
                out[at("start") + i * step] = value
    return out


def load_query(token: str, zone: str = "DE_LU", fetch: Callable[[str, dict], str] = get) -> Callable[[str, str], str]:
    """query(start, end) for download(): the hourly means of forecast and actual load as CSV text. Times are ISO 8601, in UTC."""
    if not token:
        raise ValueError("the service needs a token")
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}; known: {sorted(ZONES)}")

    def query(start: str, end: str) -> str:
        span = [dt.datetime.fromisoformat(x).replace(tzinfo=None) for x in (start, end)]
        if span[0] >= span[1]:
            raise ValueError("start must lie before end")
        columns = {}
        for name, process in PROCESSES.items():
            params = {"securityToken": token, "documentType": DOCUMENT, "processType": process, "outBiddingZone_Domain": ZONES[zone], "periodStart": span[0].strftime("%Y%m%d%H%M"), "periodEnd": span[1].strftime("%Y%m%d%H%M")}
            hours: dict[dt.datetime, list[float]] = {}
            try:
                for at, value in points(fetch(ADDRESS, params)).items():
                    hours.setdefault(at.replace(minute=0), []).append(value)
            except NoData:
                if name == "Actual Load" and not columns["Forecasted Load"]:
                    raise
            columns[name] = {at: sum(v) / len(v) for at, v in hours.items()}
        times = sorted(set().union(*columns.values()))
        lines = [",".join(["Time (UTC)", *columns])]
        lines += [",".join([f"{at:%Y-%m-%d %H:%M:%S}", *(repr(c[at]) if at in c else "-" for c in columns.values())]) for at in times if span[0] <= at < span[1]]
        return "\n".join(lines) + "\n"

    return query
