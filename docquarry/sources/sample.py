"""A sample document: the handbook of an invented bird observatory, a topic to a page."""

from __future__ import annotations

from docquarry.sources.pdf import make_pdf

PAGES = (
    ["Getting there", "The ferry to Skarrholm leaves the quay at Lindvik at 07:40 and 16:15.", "Bring boots: the path from the jetty floods at spring tide."],
    ["Ringing", "Nets are opened half an hour before sunrise and checked every twenty minutes.", "Ringer in charge is Tove Aalberg, who took over the mist nets in 2011."],
    ["Records", "The island list stands at 287 species. The last addition was a booted warbler."],
    ["Keeping the boat", "Fuel for the dinghy is stored behind the smokehouse, never in the boathouse.", "The outboard needs two-stroke oil at a ratio of fifty to one."],
    ["Power and water", "Eleven solar panels feed the batteries. The well gives 600 litres a day in July."],
    ["Visitors", "Bunks cost 18 crowns a night. 412 people stayed over during the spring of 2019.", "In the spring of 2018 there were 355 of them."],
    ["Seals", "Grey seals pup on the northern skerries from late February; keep 200 metres away."],
    ["If something goes wrong", "The coast guard answers on channel 16. The first-aid box hangs by the stove."],
    ["Leaving", "Sweep the dormitory, empty the stove and sign the logbook before the boat comes."],
)


def sample_pdf() -> bytes:
    return make_pdf([list(p) for p in PAGES])


def main(path: str = "sample.pdf") -> None:
    with open(path, "wb") as f:
        f.write(sample_pdf())
