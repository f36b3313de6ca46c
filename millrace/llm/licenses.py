"""License scan by ordered signature rules [operator 5].

Text is folded to lower-case words.  Rules are hand-written regexes over the folded
text, each with keywords of its own; a rule runs only on texts that hold one of them,
which one pass of an Aho-Corasick automaton finds.  A detection inside another of at
least its priority is dropped, the longer one winning between equal priorities and
then the earlier rule.  The base phrases report whatever the rules say.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import slices, texts, worker_cache

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: The rules, in their order: label | priority and score | keywords | regex over folded text.
#: Of the keywords one stands in every match, at the start of a word; ``_`` is a space.  {lic}, {under},
#: {v}, {ver} and {ver1} are spelled out in MACROS; {v} in a label is the version that the regex found.
RULES = r"""
apache-{v} | 5 .98 | apache | spdx {lic} identifier apache {v}
apache-{v} | 4 .95 | apache | {under} (?:the )?apache(?: software)?(?: foundation)?(?: {lic})?{ver}
apache-{v} | 3 .85 | apache | apache(?: software)? {lic}{ver}
apache-{v} | 2 .7 | apache | apache v?{v}
apache | 1 .6 | apache | (?:{under} (?:the )?)?apache(?: software)? {lic}
apache-2.0-header | 4 .95 | compliance | you may not use this file except in compliance with the {lic}
apache-2.0-grant | 3 .8 | irrevocable | perpetual worldwide non exclusive no charge royalty free irrevocable copyright {lic}
mit | 5 .98 | mit | spdx {lic} identifier mit
mit | 4 .95 | mit | {under} (?:the )?mit(?: x11| expat)?(?: style)?(?: {lic})?
mit | 3 .85 | mit | mit(?: x11| x| expat)? {lic}
mit | 3 .8 | mit | {lic} (?:is )?(?:the )?mit
mit-0 | 5 .95 | mit | mit (?:0|no attribution)(?: {lic})?
mit-grant | 4 .9 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit-condition | 3 .8 | permission | the above copyright notice and this permission notice shall be included in all copies
expat | 3 .8 | expat | expat {lic}
x11 | 3 .8 | x11 | (?:{under} (?:the )?)?x11 {lic}
x11-names | 2 .6 | advertising | shall not be used in advertising or otherwise to promote the sale use or other dealings
bsd-2-clause | 5 .98 | bsd | spdx {lic} identifier bsd 2 clause
bsd-3-clause | 5 .98 | bsd | spdx {lic} identifier bsd 3 clause
bsd-2-clause | 4 .9 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd bsd)(?: {lic})?
bsd-3-clause | 4 .9 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)(?: {lic})?
bsd-4-clause | 4 .9 | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: {lic})?
bsd | 3 .85 | bsd | {under} (?:the |a )?bsd(?: style)?(?: {lic})?
bsd | 2 .75 | bsd | bsd(?: style)? {lic}
bsd-grant | 4 .9 | redistribution | redistribution and use in source and binary forms with or without modification (?:are|is) permitted
bsd-2-retain | 3 .8 | redistributions | redistributions of source code must retain the above copyright notice
bsd-2-reproduce | 3 .8 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-endorse | 3 .85 | endorse | may be used to endorse or promote products derived from this software
bsd-4-advertise | 3 .85 | advertising | all advertising materials mentioning features or use of this software must display
0bsd | 5 .95 | 0bsd | (?:spdx {lic} identifier |{under} (?:the )?)?0bsd(?: {lic})?
0bsd | 4 .9 | bsd | (?:zero clause bsd|bsd zero clause|free public {lic})
isc | 5 .98 | isc | spdx {lic} identifier isc
isc | 3 .85 | isc | (?:{under} (?:the )?)?isc {lic}
isc-grant | 4 .9 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee
hpnd-grant | 3 .85 | permission | permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation
ntp | 3 .8 | ntp | (?:{under} (?:the )?)?ntp {lic}
agpl-{v} | 5 .98 | agpl | spdx {lic} identifier agpl {v}(?: only| or later)?
agpl-{v} | 4 .95 | affero | (?:{under} (?:the )?(?:terms of (?:the )?)?)?(?:gnu )?affero general public {lic}{ver}
agpl-{v} | 4 .95 | agpl | (?:{under} (?:the )?)?(?:gnu )?agpl ?{ver1}
agpl | 2 .8 | affero | (?:gnu )?affero (?:general public {lic}|gpl)
agpl | 2 .75 | agpl | {under} (?:the )?(?:gnu )?agpl
agpl-network | 3 .8 | network | all users interacting with it remotely through a computer network
lgpl-{v} | 5 .98 | lgpl | spdx {lic} identifier lgpl {v}(?: only| or later)?
lgpl-{v} | 4 .95 | lesser library | (?:{under} (?:the )?(?:terms of (?:the )?)?)?gnu (?:lesser|library)(?: or lesser)? general public {lic}{ver}
lgpl-{v} | 4 .95 | lgpl | (?:{under} (?:the )?)?(?:gnu )?lgpl ?{ver1}
lgpl | 2 .8 | lesser library | gnu (?:lesser|library)(?: or lesser)? general public {lic}
lgpl | 2 .75 | lgpl | {under} (?:the )?(?:gnu )?lgpl
gpl-{v} | 5 .98 | gpl | spdx {lic} identifier gpl {v}(?: only| or later)?
gpl-{v} | 3 .95 | gnu gpl | (?:{under} (?:the )?(?:terms of (?:the )?)?)?(?:gnu|gpl) general public {lic}(?: gpl)?(?: as published by the free software foundation)?(?: either)?{ver}
gpl-{v} | 3 .95 | gpl | (?:{under} (?:the )?)?(?:gnu )?gpl(?: {lic})? ?{ver1}
gpl-or-later | 4 .9 | option | version [0-9](?: [0-9])? of the {lic} or at your option any later version
gpl | 2 .8 | gnu | gnu general public {lic}
gpl | 2 .75 | gpl | {under} (?:the )?(?:gnu )?gpl(?: {lic})?
gpl | 2 .75 | gpl | (?:gnu )?gpl {lic}
gpl-copyleft | 2 .7 | redistribute | you can redistribute it and or modify it under the terms of
gpl-warranty | 2 .7 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose
gpl-copy | 2 .7 | gnu | you should have received a copy of the gnu (?:lesser |affero |library )?general public {lic}
gpl-classpath | 4 .9 | classpath | classpath(?: linking)? exception
gpl-linking | 3 .8 | linking | as a special exception .{0,80}linking
gfdl-{v} | 4 .95 | gfdl | (?:spdx {lic} identifier |{under} (?:the )?)?gfdl ?{ver1}
gfdl-{v} | 4 .95 | documentation | (?:{under} (?:the )?(?:terms of (?:the )?)?)?gnu free documentation {lic}{ver}
gfdl | 2 .8 | documentation | gnu free documentation {lic}
gfdl-invariant | 3 .8 | invariant | with no invariant sections
mpl-{v} | 5 .98 | mpl | spdx {lic} identifier mpl {v}
mpl-{v} | 4 .95 | mozilla | (?:{under} (?:the )?(?:terms of (?:the )?)?)?mozilla public {lic}{ver}
mpl-{v} | 4 .95 | mpl | (?:{under} (?:the )?)?mpl ?{ver1}
mpl | 2 .8 | mozilla | mozilla public {lic}
mpl-source-form | 4 .95 | mozilla | this source code form is subject to the terms of the mozilla public {lic}
mpl-incompatible | 3 .8 | secondary | incompatible with secondary {lic}s
epl-{v} | 4 .95 | epl | (?:spdx {lic} identifier |{under} (?:the )?)?epl ?{ver1}
epl-{v} | 4 .95 | eclipse | (?:{under} (?:the )?)?eclipse public {lic}{ver}
epl | 2 .8 | eclipse | eclipse public {lic}
edl-{v} | 4 .9 | eclipse | eclipse distribution {lic}{ver}
cddl-{v} | 4 .95 | cddl | (?:spdx {lic} identifier |{under} (?:the )?)?cddl ?{ver1}
cddl-{v} | 4 .95 | development | common development and distribution {lic}{ver}
cddl | 2 .8 | development | common development and distribution {lic}
eupl-{v} | 4 .95 | eupl | (?:spdx {lic} identifier |{under} (?:the )?)?eupl ?{ver1}
eupl-{v} | 4 .95 | european | european union public {lic}{ver}
eupl | 2 .8 | european eupl | (?:european union public {lic}|{under} (?:the )?eupl)
artistic-{v} | 4 .95 | artistic | (?:spdx {lic} identifier |{under} (?:the )?)?artistic(?: {lic})?{ver}
artistic | 2 .8 | artistic | (?:{under} (?:the )?)?artistic {lic}
perl | 3 .85 | perl | under the same terms as perl(?: [0-9])?(?: itself)?
bsl-{v} | 4 .95 | boost | boost software {lic}{ver}
bsl-1.0 | 5 .98 | bsl | spdx {lic} identifier bsl 1 0
bsl | 2 .8 | boost | boost(?: software)? {lic}
bsl-grant | 3 .85 | machine | solely in the form of machine executable object code generated by a source language processor
busl-{v} | 4 .95 | busl | (?:spdx {lic} identifier |{under} (?:the )?)?busl ?{ver1}
busl-{v} | 4 .95 | business | business source {lic}{ver}
busl | 2 .8 | business | business source {lic}
busl-change | 3 .8 | change_date | on the change date or the fourth anniversary
zlib | 5 .98 | zlib | spdx {lic} identifier zlib
zlib | 3 .85 | zlib | (?:{under} (?:the )?)?zlib(?: libpng)? {lic}
zlib-origin | 4 .9 | misrepresented | the origin of this software must not be misrepresented
zlib-altered | 3 .85 | altered | altered source versions must be plainly marked as such
libpng-{v} | 4 .9 | libpng | libpng {lic}{ver}
libpng | 2 .8 | libpng | libpng {lic}
unlicense | 4 .95 | unlicense | (?:spdx {lic} identifier |{under} )?(?:the )?unlicense
unlicense-text | 4 .95 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 4 .95 | wtfpl | (?:spdx {lic} identifier |{under} (?:the )?)?wtfpl
wtfpl | 4 .95 | want_to | do what the f[a-z]{2,3} you want to public {lic}
osl-{v} | 4 .95 | osl | (?:spdx {lic} identifier |{under} (?:the )?)?osl ?{ver1}
osl-{v} | 4 .95 | open_software | (?:{under} (?:the )?)?open software {lic}{ver}
osl | 2 .75 | open_software | open software {lic}
afl-{v} | 4 .95 | afl | (?:spdx {lic} identifier |{under} (?:the )?)?afl ?{ver1}
afl-{v} | 4 .95 | academic | academic free {lic}{ver}
afl | 2 .8 | academic | academic free {lic}
ms-pl | 4 .95 | microsoft | (?:{under} (?:the )?)?microsoft public {lic}
ms-rl | 4 .95 | microsoft | (?:{under} (?:the )?)?microsoft reciprocal {lic}
ms-lpl | 4 .95 | microsoft | microsoft limited public {lic}
ms-pl | 5 .95 | ms_ | spdx {lic} identifier ms pl
ms-rl | 5 .95 | ms_ | spdx {lic} identifier ms rl
ms-eula | 3 .8 | microsoft | microsoft software {lic} terms
cpl-{v} | 4 .95 | common_public | common public {lic}{ver}
cpl | 2 .8 | common_public | common public {lic}
cpal-{v} | 4 .95 | attribution | common public attribution {lic}{ver}
cpal | 3 .85 | attribution | common public attribution {lic}
ipl-{v} | 4 .95 | ibm | ibm public {lic}{ver}
ipl | 2 .8 | ibm | ibm public {lic}
ofl-{v} | 4 .95 | ofl | (?:spdx {lic} identifier |{under} (?:the )?)?(?:sil )?ofl ?{ver1}
ofl-{v} | 4 .95 | sil | sil open font {lic}{ver}
ofl | 2 .8 | font | (?:sil )?open font {lic}
ofl-reserved | 3 .8 | font | with reserved font names?
ufl | 3 .9 | ubuntu | ubuntu font {lic}
odbl-{v} | 4 .95 | odbl | (?:spdx {lic} identifier |{under} (?:the )?)?odbl ?{ver1}
odbl | 3 .85 | database | (?:open data commons )?open database {lic}
odc-by | 3 .9 | commons_attribution | open data commons attribution {lic}
odc-by-{v} | 5 .95 | odc | odc by ?{ver1}
pddl | 3 .9 | pddl dedication | (?:pddl|public domain dedication and {lic})
cdla-permissive-{v} | 4 .95 | cdla | cdla permissive {v}
cdla-sharing-{v} | 4 .95 | cdla | cdla sharing {v}
cdla | 2 .8 | community | community data {lic} agreement
psf-{v} | 4 .95 | psf | (?:spdx {lic} identifier |{under} (?:the )?)?psf ?{ver1}
psf | 3 .9 | python | python software foundation {lic}
python | 2 .75 | python | {under} (?:the )?python {lic}
php-{v} | 4 .95 | php | (?:the )?php {lic}{ver}
php | 2 .8 | php | (?:{under} the )?php {lic}
ruby | 3 .85 | ruby | (?:ruby {lic}|under the same terms as ruby)
postgresql | 3 .9 | postgresql | postgresql {lic}
openssl | 3 .9 | openssl | openssl {lic}
openssl-notice | 3 .85 | openssl | this product includes software developed by the openssl project
ssleay | 3 .85 | cryptographic | this product includes cryptographic software written by
openldap | 3 .9 | openldap | openldap public {lic}
sspl-{v} | 4 .95 | sspl | (?:spdx {lic} identifier |{under} (?:the )?)?sspl ?{ver1}
sspl | 3 .9 | side_public | server side public {lic}
elastic-{v} | 4 .95 | elastic | elastic {lic}{ver}
elastic | 2 .8 | elastic | elastic {lic}
commons-clause | 3 .9 | clause | commons clause {lic} condition
commons-clause | 2 .8 | clause | (?:with|under) (?:the )?commons clause
polyform-noncommercial | 4 .95 | polyform | polyform noncommercial(?: {lic})?
polyform-small-business | 4 .95 | polyform | polyform small business(?: {lic})?
polyform-strict | 4 .95 | polyform | polyform strict(?: {lic})?
polyform-shield | 4 .95 | polyform | polyform shield(?: {lic})?
parity | 3 .85 | parity | parity public {lic}
prosperity | 3 .85 | prosperity | prosperity public {lic}
blueoak | 3 .9 | blue | blue oak model {lic}
upl | 3 .9 | upl universal | (?:spdx {lic} identifier upl 1 0|universal permissive {lic})
ncsa | 3 .9 | ncsa | (?:university of illinois )?ncsa(?: open source)? {lic}
w3c | 3 .9 | w3c | w3c(?: software)?(?: notice and)? {lic}
vim | 3 .85 | vim | vim {lic}
zpl-{v} | 4 .95 | zpl | zpl ?{ver1}
zpl-{v} | 4 .95 | zope | zope public {lic}{ver}
zpl | 2 .85 | zope | zope public {lic}
json | 3 .9 | evil | shall be used for good not evil
json | 2 .75 | json | {under} (?:the )?json {lic}
beerware | 3 .9 | beerware | (?:the )?beerware {lic}
beerware | 3 .9 | beer | you can buy me a beer in return
curl | 3 .85 | curl | (?:{under} the )?curl {lic}
icu | 3 .85 | icu | icu {lic}
unicode-dfs | 3 .9 | unicode | unicode(?: inc)? {lic} agreement(?: data files and software)?
ijg | 3 .9 | jpeg | this software is based in part on the work of the independent jpeg group
libtiff | 3 .85 | libtiff | libtiff {lic}
freetype | 3 .9 | freetype | freetype(?: project)? {lic}
imagemagick | 3 .9 | imagemagick | imagemagick {lic}
intel | 3 .85 | intel | intel (?:simplified software|open source) {lic}
apsl-{v} | 4 .95 | apple | apple public source {lic}{ver}
apsl | 2 .8 | apple | apple public source {lic}
rpl-{v} | 4 .95 | reciprocal | reciprocal public {lic}{ver}
rpl | 2 .75 | reciprocal | reciprocal public {lic}
sleepycat | 3 .9 | sleepycat | sleepycat(?: public)? {lic}
qpl-{v} | 4 .95 | q_public | q public {lic}{ver}
qpl | 2 .85 | q_public qpl | (?:q public {lic}|{under} (?:the )?qpl)
cecill-{v} | 4 .95 | cecill | (?:spdx {lic} identifier |{under} (?:the )?)?cecill(?: {lic})?{ver}
cecill-b | 4 .95 | cecill | cecill b(?: {lic})?
cecill-c | 4 .95 | cecill | cecill c(?: {lic})?
cecill | 2 .8 | cecill | (?:{under} (?:the )?)?cecill(?: free software)?(?: {lic}(?: agreement)?)?
efl | 3 .85 | eiffel | eiffel forum {lic}
ecl-{v} | 4 .95 | educational | educational community {lic}{ver}
ecl | 2 .8 | educational | educational community {lic}
sissl | 3 .9 | sun_ | sun industry standards source {lic}
spl | 3 .9 | sun_ | sun public {lic}
nposl | 3 .9 | profit | non profit open software {lic}
nasa | 3 .9 | nasa | nasa open source agreement
nist-pd | 3 .85 | nist | nist (?:public domain|software) (?:notice|{lic})
lucent | 3 .9 | lucent | lucent public {lic}
plan9 | 3 .85 | plan_9 | plan 9 (?:open source )?{lic}
miros | 3 .9 | miros | miros {lic}
mulan-{v} | 4 .95 | mulan | mulan (?:psl|permissive software {lic})(?: v)? ?{v}
fair | 3 .8 | instrument | usage of the works is permitted provided that this instrument is retained
watcom | 3 .9 | watcom | sybase open watcom public {lic}
nokia | 3 .9 | nokia | nokia open source {lic}
realnetworks | 3 .9 | realnetworks | realnetworks public source {lic}
bittorrent | 3 .9 | bittorrent | bittorrent open source {lic}
ngpl | 3 .9 | nethack | nethack general public {lic}
latex-{v} | 4 .95 | lppl | lppl ?{ver1}
latex-{v} | 4 .95 | latex | latex project public {lic}{ver}
latex | 3 .85 | latex | latex project public {lic}
hippocratic | 3 .9 | hippocratic | hippocratic {lic}
anti-996 | 3 .9 | 996 | anti 996 {lic}
openrail | 3 .9 | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: {lic})?
bigscience-rail | 3 .9 | bigscience bigcode | (?:bigscience|bigcode) (?:open )?rail(?: m)?(?: {lic})?
llama-{v} | 4 .9 | llama | llama {v} community {lic}(?: agreement)?
llama | 3 .85 | llama | llama community {lic}(?: agreement)?
gemma | 3 .85 | gemma | gemma terms of use
cc0-{v} | 5 .98 | cc0 | (?:spdx {lic} identifier |{under} (?:the )?)?cc0 {v}
cc0 | 4 .95 | zero | (?:creative commons|cc) zero(?: v?{v0})?
cc0 | 2 .85 | cc0 | (?:{under} (?:the )?)?cc0
cc-by-nc-nd-{v} | 8 .95 | cc_by | cc by nc nd v?{v}
cc-by-nc-sa-{v} | 8 .95 | cc_by | cc by nc sa v?{v}
cc-by-nc-{v} | 6 .95 | cc_by | cc by nc v?{v}
cc-by-nd-{v} | 6 .95 | cc_by | cc by nd v?{v}
cc-by-sa-{v} | 6 .95 | cc_by | cc by sa v?{v}
cc-by-{v} | 4 .95 | cc_by | cc by v?{v}
cc-by-nc-nd | 7 .9 | cc_by | cc by nc nd
cc-by-nc-sa | 7 .9 | cc_by | cc by nc sa
cc-by-nc | 5 .9 | cc_by | cc by nc
cc-by-nd | 5 .9 | cc_by | cc by nd
cc-by-sa | 5 .9 | cc_by | cc by sa
cc-by | 3 .85 | cc_by | cc by
cc-by-nc-nd-{v} | 8 .95 | attribution | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? {v}
cc-by-nc-sa-{v} | 8 .95 | attribution | (?:creative commons )?attribution non ?commercial share ?alike {v}
cc-by-nc-{v} | 6 .95 | attribution | (?:creative commons )?attribution non ?commercial {v}
cc-by-nd-{v} | 6 .95 | attribution | (?:creative commons )?attribution no ?deriv(?:ative)?s?(?: works)? {v}
cc-by-sa-{v} | 6 .95 | attribution | (?:creative commons )?attribution share ?alike {v}
cc-by-{v} | 4 .95 | attribution | (?:creative commons )attribution {v}
cc-by-nc-nd | 7 .9 | attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | 7 .9 | attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc | 5 .9 | attribution | creative commons attribution non ?commercial
cc-by-nd | 5 .9 | attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa | 5 .9 | attribution | creative commons attribution share ?alike
cc-by | 3 .85 | attribution | creative commons attribution(?: {lic})?
cc-by-{v} | 5 .95 | creativecommons | creativecommons org {lic}s by {v}
cc-by-sa-{v} | 6 .95 | creativecommons | creativecommons org {lic}s by sa {v}
cc-by-nc-{v} | 6 .95 | creativecommons | creativecommons org {lic}s by nc {v}
cc-by-nd-{v} | 6 .95 | creativecommons | creativecommons org {lic}s by nd {v}
cc-by-nc-sa-{v} | 8 .95 | creativecommons | creativecommons org {lic}s by nc sa {v}
cc-by-nc-nd-{v} | 8 .95 | creativecommons | creativecommons org {lic}s by nc nd {v}
cc0-{v} | 5 .95 | creativecommons | creativecommons org publicdomain zero {v}
cc-pdm-{v} | 5 .95 | creativecommons | creativecommons org publicdomain mark {v}
creative-commons | 1 .6 | creative | (?:{under} (?:a |the )?)?creative commons {lic}
public-domain | 2 .8 | domain | (?:is|are|placed|released|dedicated|donated) (?:in|into|to) the public domain
public-domain | 1 .6 | domain | in the public domain
no-copyright | 2 .7 | disclaims | the author disclaims copyright to this source code
reserved | 1 .6 | reserved | (?:all|some) rights reserved
copyright | 1 .5 | copyright | copyright (?:c )?[0-9]{4}(?: [0-9]{4}){0,6}
proprietary | 3 .8 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 2 .7 | unauthorized | unauthorized (?:copying|use|reproduction|distribution) .{0,60}strictly prohibited
trade-secret | 3 .8 | secrets | (?:contains|contain|are|constitutes) (?:the )?(?:valuable )?trade secrets
no-redistribution | 3 .75 | redistribution | (?:no redistribution|redistribution is (?:not permitted|prohibited))
no-commercial-use | 3 .75 | commercial | (?:for non commercial use only|not for commercial use|no commercial use|non commercial purposes only)
evaluation-only | 3 .75 | evaluation | for (?:internal )?evaluation purposes only
research-only | 3 .75 | research | for (?:academic|non profit|non commercial)?(?: and)? ?research (?:use|purposes) only
personal-use-only | 3 .75 | personal | for (?:your )?personal use only
freeware | 2 .7 | freeware | (?:is|this is|as) freeware
shareware | 2 .7 | shareware | (?:is|this is|as) shareware
eula | 3 .8 | agreement | end user {lic} agreement
patent-grant | 2 .7 | patent | (?:royalty free|non exclusive) patent {lic}
warranty-disclaimer | 2 .5 | warranty | the software is provided as is without warranty of any kind
warranty-disclaimer | 2 .5 | warranties | without warranties or conditions of any kind
warranty-disclaimer | 2 .5 | warranties | any express or implied warranties including but not limited to
liability-disclaimer | 2 .5 | liable | in no event shall .{0,80}be liable for any
license-file | 1 .4 | license licence | see (?:the )?{lic}(?: txt| md)?(?: file)? for (?:details|more information|the full)
dual-license | 2 .6 | dual | dual {lic}d? under
spdx | 1 .7 | spdx | spdx {lic} identifier [0-9a-z]+
"""
MACROS = {
    "{under}": r"(?:licen[sc]ed|released|distributed|redistributed|published|available|provided|covered|governed) (?:under|by)(?: the terms(?: and conditions)? of)?",
    "{lic}": "licen[sc]e",
    "{ver}": "(?: version| ver| v)? v?{v}",
    "{ver1}": "(?:version |ver |v )?v?{v}",
    "{v0}": "[0-9]{1,2}(?: [0-9]{1,2})?",
    "{v}": "(?P<v>[0-9]{1,2}(?: [0-9]{1,2})?)",
}


@dataclass(frozen=True)
class Rule:
    label: str
    score: float
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


def make_rules() -> list[Rule]:
    """All rules in their order: the more a rule states, the higher its priority."""
    rules = []
    for line in RULES.strip().split("\n"):
        label, rank, keywords, body = line.split(" | ", 3)
        priority, score = rank.split()
        for macro, meaning in MACROS.items():
            body = body.replace(macro, meaning)
        keywords = tuple(" " + k.replace("_", " ") for k in keywords.split())
        rules.append(Rule(label, float(score), int(priority), keywords, re.compile(rf"(?<= )(?:{body})(?= )")))
    return rules


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_keyword: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for keyword in rule.keywords:
                self.by_keyword.setdefault(keyword, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for keyword in self.by_keyword:
            self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()

    def detect(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of what is left after suppression, in characters of the folded text."""
        tried = {k for _, keyword in self.automaton.iter(folded) for k in self.by_keyword[keyword]}
        return self.matches(folded, sorted(tried))

    def matches(self, folded: str, tried: Iterable[int]) -> list[tuple[int, int, str, float]]:
        """What these rules find, without a look at their keywords."""
        found, labels = [], {}
        for k in tried:
            for m in self.rules[k].pattern.finditer(folded):
                found.append((m.start(), m.end(), k))
                if "{v}" in self.rules[k].label:
                    labels[found[-1]] = self.rules[k].label.replace("{v}", m["v"].replace(" ", "."))
        return [(s, e, labels.get((s, e, k), self.rules[k].label), self.rules[k].score) for s, e, k in suppress(found, self.rules)]


def suppress(found: list[tuple[int, int, int]], rules: list[Rule]) -> list[tuple[int, int, int]]:
    """Drop each interval that lies in another of higher priority, or of equal priority and longer or of an earlier rule."""
    found = sorted(found)
    longest = max((e - s for s, e, _ in found), default=0)
    starts = [s for s, _, _ in found]
    kept, low = [], 0
    for s, e, k in found:
        while starts[low] < s - longest:
            low += 1
        j, covered = low, False
        while j < len(found) and starts[j] <= s and not covered:
            s2, e2, k2 = found[j]
            if k2 != k or (s2, e2) != (s, e):
                strength = (rules[k2].priority, e2 - s2, -k2)
                covered = e2 >= e and strength > (rules[k].priority, e - s, -k)
            j += 1
        if not covered:
            kept.append((s, e, k))
    return kept


#: Folding: upper-case A-Z to lower case; what is no digit, letter or non-ASCII byte to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,last_word:long,score:double>>"


def report(text: str, scanner: Scanner) -> tuple:
    words = text.encode().translate(_FOLD).split()
    folded = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, labels = [], set()
    for phrase, label in BASE:
        at = folded.find(f" {phrase} ")
        while at >= 0:
            base.append(at)
            labels.add(label)
            at = folded.find(f" {phrase} ", at + 1)
    found = scanner.detect(folded)
    if base or found:
        spaces = np.flatnonzero(np.frombuffer(folded.encode("latin-1"), np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at)) - 1  # noqa: E731  the word that holds this place, from 0
    detections = [{"label": label, "first_word": word(s), "last_word": word(e), "score": score} for s, e, label, score in found]
    first, last = (word(min(base) + 1), word(max(base) + 1)) if base else (None, None)
    score = max([d["score"] for d in detections] + [1.0] * bool(base), default=0.0)
    return len(words), len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {d["label"] for d in detections})), score, detections


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, labels and detections of every row (see REPORT); words count from 0.

    score: of the surest rule, 1 with a base phrase, 0 without any detection.  A null
    text counts as empty and has no words; repeated rows and null doc_ids are kept; an
    empty table gives an empty one; a text of any length is scanned whole; other columns
    are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_cache("licenses", lambda: Scanner(make_rules()))
        detection = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), detection]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for part in slices(batches):
            rows = [report(t or "", scanner) for t in part.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    return texts(docs, id_col, text_col).mapInArrow(run, REPORT)
