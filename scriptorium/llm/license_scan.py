"""Licence scans: ordered signature rules behind a keyword prefilter, with suppression of overlapping detections.

Each rule has a label, a keyword and a regex.  A document's lowered text is first searched for the keywords; only the
rules of keywords that occur are run.  Detections are then taken in rule order (earlier rules have priority; of one rule
the longer, then the earlier one): a detection that lies within one already taken is suppressed.

Beside the rules, a few base phrases are counted as words that stand consecutively; their labels always stay.

Defined results: a null text reads as empty, and an empty one has no words, places or labels and score 0; repeated rows
each get their result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, LOWER, slices, spans, table, text_bytes, tune

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Signatures by family, written as "label | keyword | regex".  `~` stands for a run of blanks or punctuation between
# words, `V` for the optional word "version".  More specific rules stand before more general ones: order is priority.
_TEXTS = r"""
agpl-3.0-or-later | affero | gnu~affero~general~public~licen[sc]e,?~V~3(\.0)?,?~(?:of~the~license,?~)?or~(?:\(at~your~option\)~)?any~later
agpl-3.0 | affero | gnu~affero~general~public~licen[sc]e,?~(?:as~published~by~the~free~software~foundation,?~)?V~3(\.0)?
agpl-1.0 | affero | affero~general~public~licen[sc]e,?~V~1(\.0)?
agpl | affero | affero~general~public~licen[sc]e
agpl-3.0 | agpl | agpl~v?3(\.0)?
lgpl-3.0-or-later | lesser | gnu~lesser~general~public~licen[sc]e,?~V~3(\.0)?,?~(?:of~the~license,?~)?or~(?:\(at~your~option\)~)?any~later
lgpl-3.0 | lesser | gnu~lesser~general~public~licen[sc]e,?~(?:as~published~by~the~free~software~foundation,?~)?V~3(\.0)?
lgpl-2.1-or-later | lesser | gnu~lesser~general~public~licen[sc]e,?~V~2\.1,?~(?:of~the~license,?~)?or~(?:\(at~your~option\)~)?any~later
lgpl-2.1 | lesser | gnu~lesser~general~public~licen[sc]e,?~V~2\.1
lgpl-2.0 | library | gnu~library~general~public~licen[sc]e,?~V~2(\.0)?
lgpl | library | gnu~library~general~public~licen[sc]e
lgpl | lesser | gnu~lesser~general~public~licen[sc]e
lgpl-3.0 | lgpl | lgpl~v?3(\.0)?
lgpl-2.1 | lgpl | lgpl~v?2\.1
lgpl | lgpl | \blgpl\b
gpl-3.0-or-later | general public | gnu~general~public~licen[sc]e,?~V~3(\.0)?,?~(?:of~the~license,?~)?or~(?:\(at~your~option\)~)?any~later
gpl-2.0-or-later | general public | gnu~general~public~licen[sc]e,?~V~2(\.0)?,?~(?:of~the~license,?~)?or~(?:\(at~your~option\)~)?any~later
gpl-3.0 | general public | gnu~general~public~licen[sc]e,?~(?:as~published~by~the~free~software~foundation,?~)?V~3(\.0)?
gpl-2.0 | general public | gnu~general~public~licen[sc]e,?~(?:as~published~by~the~free~software~foundation,?~)?V~2(\.0)?
gpl-1.0 | general public | gnu~general~public~licen[sc]e,?~V~1(\.0)?
gpl | general public | gnu~general~public~licen[sc]e
gpl-3.0 | gpl | \bgpl~v?3(\.0)?\b
gpl-2.0 | gpl | \bgpl~v?2(\.0)?\b
gpl | gpl | \bgnu~gpl\b
gpl | free software foundation | redistribute~it~and/or~modify~it~under~the~terms~of~the~gnu~general
gcc-exception | gcc | gcc~runtime~library~exception
classpath-exception | classpath | classpath~exception|linking~this~library~statically~or~dynamically
gfdl-1.3 | free documentation | gnu~free~documentation~licen[sc]e,?~V~1\.3
gfdl-1.2 | free documentation | gnu~free~documentation~licen[sc]e,?~V~1\.2
gfdl-1.1 | free documentation | gnu~free~documentation~licen[sc]e,?~V~1\.1
gfdl | free documentation | gnu~free~documentation~licen[sc]e
apache-2.0 | apache | apache~(?:software~)?licen[sc]e,?~V~2(\.0)?
apache-1.1 | apache | apache~(?:software~)?licen[sc]e,?~V~1\.1
apache-1.0 | apache | apache~(?:software~)?licen[sc]e,?~V~1(\.0)?
apache-2.0 | apache | apache~2(\.0)?\b
apache-2.0 | apache | www\.apache\.org/licenses/license-2\.0
apache | apache | apache~(?:software~)?licen[sc]e
mit | mit | \bmit~licen[sc]e|licen[sc]ed~under~(?:the~)?mit\b|the~mit~\(?expat\)?~licen[sc]e
mit | permission | permission~is~hereby~granted,?~free~of~charge,?~to~any~person~obtaining~a~copy
mit | opensource.org | opensource\.org/licenses/mit\b
mit-0 | mit | \bmit~no~attribution|\bmit-0\b
x11 | x11 | \bx11~licen[sc]e
x11 | x consortium | x~consortium~shall~not~be~used
isc | isc | \bisc~licen[sc]e
isc | permission | permission~to~use,?~copy,?~modify,?~and/or~distribute~this~software~for~any~purpose
ntp | permission | permission~to~use,?~copy,?~modify,?~and~distribute~this~software~and~its~documentation
bsd-4-clause | advertising | all~advertising~materials~mentioning~features
bsd-4-clause | bsd | (?:4~clause|four~clause|original)~bsd|bsd~4~clause
bsd-3-clause | bsd | (?:3~clause|three~clause|new|modified|revised)~bsd|bsd~3~clause
bsd-3-clause | endorse | neither~the~name~of~.{0,80}?~nor~the~names~of~its~contributors
bsd-2-clause | bsd | (?:2~clause|two~clause|simplified|freebsd)~bsd|bsd~2~clause
bsd-1-clause | bsd | (?:1~clause|one~clause)~bsd|bsd~1~clause
bsd-0 | bsd | (?:0~clause|zero~clause)~bsd|\b0bsd\b
bsd | redistribution | redistribution~and~use~in~source~and~binary~forms
bsd | bsd | \bbsd~licen[sc]e|bsd~style~licen[sc]e
mpl-2.0 | mozilla | mozilla~public~licen[sc]e,?~V~2(\.0)?
mpl-1.1 | mozilla | mozilla~public~licen[sc]e,?~V~1\.1
mpl-1.0 | mozilla | mozilla~public~licen[sc]e,?~V~1(\.0)?
mpl-2.0 | mozilla | mozilla\.org/mpl/2\.0
mpl | mozilla | mozilla~public~licen[sc]e
mpl-2.0 | mpl | \bmpl~v?2(\.0)?\b
epl-2.0 | eclipse | eclipse~public~licen[sc]e,?~-?~V~2(\.0)?
epl-1.0 | eclipse | eclipse~public~licen[sc]e,?~-?~V~1(\.0)?
epl | eclipse | eclipse~public~licen[sc]e
edl-1.0 | eclipse | eclipse~distribution~licen[sc]e
cddl-1.1 | distribution licen | common~development~and~distribution~licen[sc]e.{0,20}?1\.1
cddl-1.0 | distribution licen | common~development~and~distribution~licen[sc]e
cpl-1.0 | common public | common~public~licen[sc]e,?~V~1(\.0)?
cpl | common public | common~public~licen[sc]e
ipl-1.0 | ibm | ibm~public~licen[sc]e
eupl-1.2 | european union | european~union~public~licen[sc]e.{0,20}?1\.2
eupl-1.1 | european union | european~union~public~licen[sc]e.{0,20}?1\.1
eupl | european union | european~union~public~licen[sc]e
osl-3.0 | open software | open~software~licen[sc]e.{0,20}?3\.0
osl | open software | open~software~licen[sc]e
afl-3.0 | academic free | academic~free~licen[sc]e.{0,20}?3\.0
afl | academic free | academic~free~licen[sc]e
artistic-2.0 | artistic | artistic~licen[sc]e,?~V~2(\.0)?
artistic-1.0 | artistic | artistic~licen[sc]e,?~V~1(\.0)?
artistic | artistic | artistic~licen[sc]e
bsl-1.0 | boost | boost~software~licen[sc]e
busl-1.1 | business source | business~source~licen[sc]e
zlib | zlib | \bzlib~licen[sc]e|zlib/libpng
zlib | as-is | this~software~is~provided~'?as-is'?,?~without~any~express~or~implied
libpng | libpng | libpng~licen[sc]e
unlicense | unlicense | \bthe~unlicense\b|unlicense\.org
unlicense | public domain | free~and~unencumbered~software~released~into~the~public~domain
wtfpl | wtfpl | \bwtfpl\b
wtfpl | what the | do~what~the~f\S{1,4}~you~want~to~public~licen[sc]e
beerware | beer | beer-?ware~licen[sc]e|buy~me~a~beer
psf-2.0 | python software | python~software~foundation~licen[sc]e
python-2.0 | python | \bpython~licen[sc]e
php-3.01 | php | \bphp~licen[sc]e
ruby | ruby | \bruby(?:'s)?~licen[sc]e
perl | perl | same~terms~as~perl~itself
openssl | openssl | \bopenssl~licen[sc]e|openssl~project~for~use~in
ssleay | ssleay | ssleay~licen[sc]e|eric~young
postgresql | postgresql | postgresql~licen[sc]e
ncsa | illinois | university~of~illinois/?~?ncsa~open~source
upl-1.0 | universal permissive | universal~permissive~licen[sc]e
ms-pl | microsoft | microsoft~public~licen[sc]e
ms-rl | microsoft | microsoft~reciprocal~licen[sc]e
qpl-1.0 | q public | \bq~public~licen[sc]e
sleepycat | sleepycat | sleepycat~licen[sc]e
ofl-1.1 | open font | sil~open~font~licen[sc]e.{0,20}?1\.1
ofl | open font | open~font~licen[sc]e
sspl-1.0 | server side | server~side~public~licen[sc]e
elastic-2.0 | elastic | elastic~licen[sc]e.{0,12}?2(\.0)?
elastic | elastic | elastic~licen[sc]e
commons-clause | commons clause | commons~clause
polyform-nc | polyform | polyform~noncommercial
polyform | polyform | polyform~\w+~licen[sc]e
odbl-1.0 | open database | open~database~licen[sc]e|\bodbl\b
odc-by-1.0 | open data commons | open~data~commons~attribution
pddl-1.0 | public domain dedication | public~domain~dedication~and~licen[sc]e
cc0-1.0 | cc0 | \bcc0\b(?:~1\.0)?
cc0-1.0 | publicdomain | creativecommons\.org/publicdomain/zero
public-domain | public domain | (?:is|are|released~into|placed~in|dedicated~to)~(?:in~)?(?:the~)?public~domain
openrail | openrail | \b(?:creativeml~|bigscience~)?open~?rail(?:\+\+)?(?:-m|-s)?\b
llama | llama | \bllama~\d?~?(?:community~)?licen[sc]e
all-rights-reserved | rights reserved | all~rights~reserved
proprietary | proprietary | proprietary~and~confidential|proprietary~licen[sc]e
copyright | copyright | copyright~(?:\(c\)|©)?~?(?:19|20)\d\d
licence-reference | spdx | spdx-license-identifier:~[a-z0-9.+-]+
licence-reference | license | (?:see|read)~(?:the~)?(?:file~)?(?:license|copying)(?:\.txt|\.md)?~(?:file~)?for~(?:details|more|licen)
# Passages of licence bodies, which tell a licence whose name was cut off.
apache-2.0 | derivative works | subject~to~the~terms~and~conditions~of~this~license,?~each~contributor~hereby~grants~to~you
apache-2.0 | notice | you~must~cause~any~modified~files~to~carry~prominent~notices
apache-2.0 | as is | distributed~on~an~"?as~is"?~basis,?~without~warranties~or~conditions~of~any~kind
apache-2.0 | in compliance | you~may~not~use~this~file~except~in~compliance~with~the~license
apache-1.1 | apache | products~derived~from~this~software~may~not~be~called~"?apache
mit | sublicense | to~use,?~copy,?~modify,?~merge,?~publish,?~distribute,?~sublicense,?~and/or~sell
mit | substantial portions | this~permission~notice~shall~be~included~in~all~copies~or~substantial~portions
mit | authors or copyright | in~no~event~shall~the~authors~or~copyright~holders~be~liable~for~any~claim
isc | author disclaims | the~author~disclaims~all~warranties~with~regard~to~this~software
isc | fee | for~any~purpose~with~or~without~fee~is~hereby~granted
bsd-3-clause | endorse | may~be~used~to~endorse~or~promote~products~derived~from
bsd | binary form | redistributions~in~binary~form~must~reproduce~the~above~copyright
bsd | source code | redistributions~of~source~code~must~retain~the~above~copyright
bsd | contributors | by~the~copyright~holders~and~contributors~"?as~is
bsd-4-clause | acknowledgement | must~display~the~following~acknowledge?ment
bsd-2-clause-patent | patent | bsd~(?:2~clause~)?plus~patent|bsd~\+~patent
bsd-3-clause-clear | clear bsd | clear~bsd~licen[sc]e
bsd-3-clause-lbnl | lawrence berkeley | lawrence~berkeley~national~lab\w*.{0,40}?bsd
gpl | freedom | guarantee~your~freedom~to~share~and~change
gpl | merchantability | without~even~the~implied~warranty~of~merchantability~or~fitness
gpl-3.0 | propagate | to~"?propagate"?~a~work~means~to~do~anything~with~it
gpl-3.0 | anti-circumvention | protecting~users'?~legal~rights~from~anti-circumvention~law
gpl-2.0 | temple place | 59~temple~place~suite~330
gpl-2.0 | franklin | 51~franklin~st(?:reet)?,?~fifth~floor
gpl-2.0-or-later | either version 2 | either~version~2~of~the~license,?~or~\(?at~your~option
gpl-3.0-or-later | either version 3 | either~version~3~of~the~license,?~or~\(?at~your~option
lgpl-2.1-or-later | either version 2.1 | either~version~2\.1~of~the~license,?~or~\(?at~your~option
lgpl | work that uses the library | work~that~uses~the~library
lgpl | linked with | combined~or~linked~with~a~"?work~that~uses
agpl-3.0 | remote network | all~users~interacting~with~it~remotely~through~a~computer~network
gfdl | invariant sections | with~no~invariant~sections,?~no~front-?cover~texts
gfdl | transparent copy | machine-?readable~transparent~copy
mpl-2.0 | mpl was not distributed | if~a~copy~of~the~mpl~was~not~distributed~with~this~file
mpl-2.0 | secondary licen | incompatible~with~secondary~licen[sc]es
mpl-1.1 | initial developer | the~initial~developer~of~the~original~code~is
epl | agreement steward | the~eclipse~foundation~is~the~initial~agreement~steward
cddl-1.0 | cddl | \bcddl\b
cc-by | attribution | you~must~give~appropriate~credit,?~provide~a~link~to~the~licen[sc]e
cc-by-nc | noncommercial | you~may~not~use~the~material~for~commercial~purposes
cc-by-sa | share | you~must~distribute~your~contributions~under~the~same~licen[sc]e~as~the~original
cc-by-nd | transform | if~you~remix,?~transform,?~or~build~upon~the~material,?~you~may~not~distribute
cc0-1.0 | waive | overtly,?~fully,?~permanently,?~irrevocably~and~unconditionally~waives
cc0-1.0 | universal | cc0~1\.0~universal
unlicense | dedicate | we~make~this~dedication~for~the~benefit~of~the~public~at~large
zlib | misrepresented | the~origin~of~this~software~must~not~be~misrepresented
zlib | altered | altered~source~versions~must~be~plainly~marked~as~such
bsl-1.0 | machine-executable | solely~in~the~form~of~machine-executable~object~code
ofl-1.1 | reserved font | reserved~font~name\(?s?\)?
ofl-1.1 | bundled | may~be~bundled,?~redistributed~and/or~sold~with~any~software
artistic-2.0 | standard version | distribution~of~modified~versions~of~the~package~as~source
artistic-1.0 | semblance | maintains~some~semblance~of~artistic~control
psf-2.0 | beopen | beopen\.com|corporation~for~national~research~initiatives
openssl | openssl toolkit | software~developed~by~the~openssl~project
ncsa | this license with the | permission~is~hereby~granted.{0,80}?to~deal~with~the~software
postgresql | university of california | in~no~event~shall~the~university~of~california~be~liable
wtfpl | everyone is permitted | everyone~is~permitted~to~copy~and~distribute~verbatim~or~modified
busl-1.1 | change date | change~date:?~.{0,40}?change~licen[sc]e
sspl-1.0 | service source code | make~the~service~source~code~available
elastic-2.0 | managed service | provide~the~software~to~third~parties~as~a~hosted~or~managed~service
commons-clause | sell | the~grant~of~rights.{0,60}?does~not~include.{0,60}?right~to~sell
openrail | use-based | use-?based~restrictions~(?:as~)?(?:set~forth|in)
llama | llama | built~with~(?:meta~)?llama
gemma | gemma | gemma~terms~of~use
# Further licences by name.
0bsd | zero | zero-?clause~bsd
afl-2.1 | academic free | academic~free~licen[sc]e.{0,20}?2\.1
apsl-2.0 | apple | apple~public~source~licen[sc]e
blueoak-1.0.0 | blue oak | blue~oak~model~licen[sc]e
bittorrent-1.1 | bittorrent | bittorrent~open~source~licen[sc]e
cecill-b | cecill | \bcecill~b\b
cecill-c | cecill | \bcecill~c\b
cecill-2.1 | cecill | \bcecill(?:~(?:free~software~)?licen[sc]e)?.{0,12}?2\.1
cecill | cecill | \bcecill\b
cpal-1.0 | attribution licen | common~public~attribution~licen[sc]e
ecl-2.0 | educational | educational~community~licen[sc]e
efl-2.0 | eiffel | eiffel~forum~licen[sc]e
etalab-2.0 | etalab | (?:etalab~)?licence~ouverte|etalab~2\.0
fair | fair licen | \bfair~licen[sc]e\b
hpnd | historical permission | historical~permission~notice~and~disclaimer
icu | unicode | \bicu~licen[sc]e|unicode,?~inc\.?~licen[sc]e
ijg | jpeg group | independent~jpeg~group
jasper-2.0 | jasper | jasper~licen[sc]e
json | evil | shall~be~used~for~good,?~not~evil
lppl-1.3c | latex | latex~project~public~licen[sc]e
mulanpsl-2.0 | mulan | mulan~(?:psl|permissive~software~licen[sc]e)
nasa-1.3 | nasa | nasa~open~source~agreement
netcdf | netcdf | \bnetcdf~licen[sc]e
npl-1.1 | netscape | netscape~public~licen[sc]e
ogl-uk-3.0 | open government | open~government~licen[sc]e
oldap-2.8 | openldap | openldap~public~licen[sc]e
parity-7.0.0 | parity | parity~public~licen[sc]e
prosperity-3.0.0 | prosperity | prosperity~public~licen[sc]e
rpl-1.5 | reciprocal public | reciprocal~public~licen[sc]e
rpsl-1.0 | realnetworks | realnetworks~public~source
sissl | sun industry | sun~industry~standards~source~licen[sc]e
tcl | tcl | \btcl(?:/tk)?~licen[sc]e
unicode-3.0 | unicode | unicode~licen[sc]e~v?3
vim | vim | \bvim~licen[sc]e
w3c | w3c | \bw3c~(?:software|document)~(?:notice|licen[sc]e)
watcom-1.0 | watcom | sybase~open~watcom~public~licen[sc]e
zpl-2.1 | zope | zope~public~licen[sc]e
"""
#: Further labels that a machine-readable SPDX tag names; each becomes a rule on the tag.
_SPDX = """
0bsd aal afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0
blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0
cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c
cpal-1.0 cpl-1.0 ecl-2.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0
gpl-3.0-only gpl-3.0-or-later hpnd icu ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0
lgpl-3.0-only lgpl-3.0-or-later libpng-2.0 lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa ntp
odbl-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sissl sleepycat sspl-1.0
unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
"""
#: Creative Commons: the elements of a licence, its words, and versions.
_CC_ELEMENTS = {
    "by-nc-sa": "attribution~non-?commercial~share-?~?alike", "by-nc-nd": "attribution~non-?commercial~no-?~?deriv(?:ative)?s?", "by-nc": "attribution~non-?commercial",
    "by-sa": "attribution~share-?~?alike", "by-nd": "attribution~no-?~?deriv(?:ative)?s?", "by": "attribution",
}
_CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    #: How much of a detection's worth a rule gives: tags and full names more than bare mentions.
    weight: float


def _compiled(source: str) -> re.Pattern:
    return re.compile(source.replace("~", r"[\s\-,;:*#/>]{0,6}").replace("V", r"(?:v(?:ersion|\.)?)?"), re.S)


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    found = [Rule(label, "spdx-license", re.compile(r"spdx-license-identifier:\s*\(?" + re.escape(label) + r"(?![a-z0-9.+-])"), 1.0) for label in _SPDX.split()]
    for elements, words in _CC_ELEMENTS.items():
        short = elements.replace("-", r"[\s\-]{1,2}")
        for version in _CC_VERSIONS:
            number = re.escape(version)
            found.append(Rule(f"cc-{elements}-{version}", "cc", re.compile(rf"\bcc[\s\-]{{0,2}}{short}[\s\-]{{1,2}}v?{number}"), 1.0))
            found.append(Rule(f"cc-{elements}-{version}", "creativecommons", re.compile(rf"creativecommons\.org/licenses/{elements}/{number}"), 1.0))
        found.append(Rule(f"cc-{elements}", "cc", re.compile(rf"\bcc[\s\-]{{1,2}}{short}\b"), 0.8))
        found.append(Rule(f"cc-{elements}", "creative commons", _compiled(rf"creative~commons~{words}"), 0.8))
    for line in _TEXTS.strip().splitlines():
        if line.startswith("#"):
            continue
        label, keyword, source = (x.strip() for x in line.split(" | ", 2))
        found.append(Rule(label, keyword, _compiled(source), 0.9 if re.search(r"\d", label) else 0.7))
    return tuple(found)


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    order: int
    weight: float


def detect(lowered: str) -> list[Detection]:
    """Detections in a lowered text that no prior one contains, by start."""
    present: dict[str, bool] = {}
    found = []
    for order, rule in enumerate(rules()):
        if rule.keyword not in present:
            present[rule.keyword] = rule.keyword in lowered
        if present[rule.keyword]:
            found += [Detection(m.start(), m.end(), rule.label, order, rule.weight) for m in rule.pattern.finditer(lowered) if m.end() > m.start()]
    return sorted(suppress(found), key=lambda d: (d.start, d.end, d.order))


def suppress(found: list[Detection]) -> list[Detection]:
    """In rule order, longer first: keep what does not lie within a kept detection.  Kept ones are held so that ends rise with starts."""
    import bisect

    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for d in sorted(found, key=lambda d: (d.order, d.start - d.end, d.start)):
        at = bisect.bisect_right(starts, d.start)
        # Among kept intervals that begin no later, the last of this chain reaches furthest.
        if at and ends[at - 1] >= d.end:
            continue
        kept.append(d)
        last = at
        while last < len(starts) and ends[last] <= d.end:
            last += 1
        starts[at:last], ends[at:last] = [d.start], [d.end]
    return kept


_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_PHRASE_WORDS = {tuple(phrase.split()): label for phrase, label in PHRASES.items()}
_FIRST_WORDS = {words[0] for words in _PHRASE_WORDS}
#: A text without any of these has no base phrase.
_PHRASE_GATES = ("license", "cc")


def base_places(lowered: str) -> list[tuple[int, int, str]]:
    """First word, number of words and label of each place where a base phrase's words stand consecutively."""
    if not any(gate in lowered for gate in _PHRASE_GATES):
        return []
    words = _WORD.findall(lowered)
    return [(i, len(phrase), label) for i, word in enumerate(words) if word in _FIRST_WORDS for phrase, label in _PHRASE_WORDS.items() if tuple(words[i : i + len(phrase)]) == phrase]


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[Detection]]:
    """Base places and detections of one text."""
    lowered = ascii_lower(text or "")
    return base_places(lowered), detect(lowered)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row a document (columns doc_id, text): counts, labels, score and the detections' spans in the lowered text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                _, _, owners = spans(LOWER[data], offsets, ALNUM)
                n_words = np.bincount(owners, minlength=part.num_rows)
                rows = []
                for t in part.column("text"):
                    base, found = scan(t.as_py())
                    names = {label for _, _, label in base}
                    every = names | {d.label for d in found}
                    weights = [0.9] * len(base) + [d.weight for d in found]
                    rows.append((len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(names)), ",".join(sorted(every)), float(max(weights, default=0.0)), [{"start": d.start, "end": d.end, "label": d.label} for d in found]))
                columns = [part.column("doc_id"), pa.array(n_words, pa.int64())]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))]
                columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                schema = schema or pa.schema(list(zip(("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"), (c.type for c in columns), strict=True)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


def base_counts(docs: DataFrame) -> DataFrame:
    """What SQL can say of the scan: words, places of the base phrases, and their labels."""
    return license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_counts(table(spark, sf_dir, "documents"))


#: The base columns: a word array for each text, and a place wherever a phrase's words are a slice of it.
BASE_ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
phrases AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) AS t(p, label)),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS pos FROM w, phrases),
found AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM places GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN found USING (doc_id)
"""
