"""Writes license_digests.csv, the digests of long licences' texts: python -m huescope.llm.license_digests [FOLDER OF TEXTS]

Each text counts with and without title, notice and appendix, with either form of its web addresses and with the foundation's earlier
postal address, in lines as they are and with each paragraph on one line (as lines that start with "copyright" are no part of the form).
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

#: Licence: (file, where else the text may start, where else it may end).
_GNU = (r"^[^\n]*Copyright \(C\)", r"^\s*(?:0\. )?P(?:reamble|REAMBLE)"), (r"^\s*END OF TERMS", r"^\s*(?:Appendix: )?How to Apply")
TEXTS = {
    "Apache-2.0": ("Apache-2.0", (r"^\s*Version 2", r"^\s*TERMS AND CONDITIONS"), (r"^\s*END OF TERMS", r"^\s*APPENDIX: ")),
    "Artistic-1.0-Perl": ("Artistic", (r"^\s*Preamble",), (r"^\s*The End",)),
    "CC0-1.0": ("CC0-1.0", (r"^CC0 1\.0", r"^\s*CREATIVE COMMONS CORP", r"^Statement of Purpose"), ()),
    "GFDL-1.2": ("GFDL-1.2", _GNU[0], (r"^ADDENDUM",)),
    "GFDL-1.3": ("GFDL-1.3", _GNU[0], (r"^ADDENDUM",)),
    "GPL-1.0": ("GPL-1", *_GNU),
    "GPL-2.0": ("GPL-2", *_GNU),
    "GPL-3.0": ("GPL-3", *_GNU),
    "LGPL-2.0": ("LGPL-2", *_GNU),
    "LGPL-2.1": ("LGPL-2.1", *_GNU),
    "LGPL-3.0": ("LGPL-3", (_GNU[0][0], r"^\s*This version of the GNU Lesser"), ()),
    "MPL-1.1": ("MPL-1.1", (r"^1\. Definitions",), (r"^EXHIBIT A",)),
    "MPL-2.0": ("MPL-2.0", (r"^1\. Definitions",), (r"^Exhibit A", r"^Exhibit B")),
}
_POSTAL = re.compile(r"51 Franklin St(?:reet)?,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?(\s+USA)")


def forms(text: str, starts: tuple[str, ...], ends: tuple[str, ...]) -> list[str]:
    """A licence's text as it may be met."""
    first, last = [0], [len(text)]
    for found, patterns in ((first, starts), (last, ends)):
        for p in patterns:
            found.append(re.search(p, text, re.M).start())
    cut = {text[a:b] for a in first for b in last}
    cut |= {_POSTAL.sub(r"59 Temple Place, Suite 330, Boston, MA 02111-1307\1", t) for t in cut}
    cut |= {t.replace("https://", "http://") for t in cut} | {t.replace("http://", "https://") for t in cut}
    return sorted(cut | {re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", t) for t in cut})


def main(folder: str = "/usr/share/common-licenses") -> None:
    from .licenses import DIGESTS, known_digests

    found = known_digests({name: forms(Path(folder, file).read_text(), starts, ends) for name, (file, starts, ends) in TEXTS.items()})
    DIGESTS.write_text("".join(f"{d},{name}\n" for d, name in sorted(found, key=lambda x: x[::-1])))


if __name__ == "__main__":
    main(*sys.argv[1:])
