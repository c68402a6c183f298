"""Operator 4: licence scans.

One Aho-Corasick automaton finds notice phrases and identifier tags in the words
of a text; another counts the place of each tag in the text itself. The
expression after a tag, up to the line's end, is read by a shunting-yard parser
and evaluated against a set of accepted licences. Both scans take time linear in
the text, whatever the number of tags.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.base import documents, map_texts

# Base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# The method's own phrases and their labels.
OWN_PHRASES = {
    "academic free license": "afl",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "business source license": "busl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "do what the fuck you want to public license": "wtfpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "isc license": "isc",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "mozilla public license": "mpl",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "open data commons attribution license": "odc-by",
    "open database license": "odbl",
    "open software license": "osl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "postgresql license": "postgresql",
    "python software foundation license": "psf",
    "redistribution and use in source and binary forms": "bsd",
    "server side public license": "sspl",
    "sil open font license": "ofl",
    "the unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "universal permissive license": "upl",
    "you may not use this file except in compliance with the license": "apache",
    "zlib license": "zlib",
    "zope public license": "zpl",
}
TAG = "spdx-license-identifier:"
#: How sure a place of each sort makes it that a licence is stated.
WEIGHTS = {"base": 0.6, "own": 0.7, "tag": 0.95}
ACCEPTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "cc-by-4.0"})

# Licence identifiers in lower case; a family has one for each of its versions.
FAMILIES = {
    "afl": "1.1 1.2 2.0 2.1 3.0",
    "apache": "1.0 1.1 2.0",
    "apsl": "1.0 1.1 1.2 2.0",
    "artistic": "1.0 1.0-cl8 1.0-perl 2.0",
    "bittorrent": "1.0 1.1",
    "blueoak": "1.0.0",
    "bsd-2-clause": "darwin first-lines freebsd netbsd patent views",
    "bsd-3-clause": "acpica attribution clear flex hp lbnl modification no-military-license no-nuclear-license no-nuclear-license-2014 no-nuclear-warranty open-mpi sun",
    "bsd-4-clause": "shortened uc",
    "bzip2": "1.0.5 1.0.6",
    "cddl": "1.0 1.1",
    "cdla": "permissive-1.0 permissive-2.0 sharing-1.0",
    "cecill": "1.0 1.1 2.0 2.1 b c",
    "cern-ohl": "1.1 1.2 p-2.0 s-2.0 w-2.0",
    "copyleft-next": "0.3.0 0.3.1",
    "ecl": "1.0 2.0",
    "efl": "1.0 2.0",
    "epl": "1.0 2.0",
    "eupl": "1.0 1.1 1.2",
    "hpnd": "doc export-us sell-variant",
    "liliq": "p-1.1 r-1.1 rplus-1.1",
    "lpl": "1.0 1.02",
    "lppl": "1.0 1.1 1.2 1.3a 1.3c",
    "mit": "0 advertising cmu enna feh festival modern-variant open-group wu",
    "mpl": "1.0 1.1 2.0 2.0-no-copyleft-exception",
    "mulanpsl": "1.0 2.0",
    "nlod": "1.0 2.0",
    "npl": "1.0 1.1",
    "ofl": "1.0 1.0-no-rfn 1.0-rfn 1.1 1.1-no-rfn 1.1-rfn",
    "ogl-uk": "1.0 2.0 3.0",
    "oldap": "1.1 1.2 1.3 1.4 2.0 2.0.1 2.1 2.2 2.2.1 2.2.2 2.3 2.4 2.5 2.6 2.7 2.8",
    "osl": "1.0 1.1 2.0 2.1 3.0",
    "parity": "6.0.0 7.0.0",
    "php": "3.0 3.01",
    "polyform": "noncommercial-1.0.0 small-business-1.0.0",
    "python": "2.0 2.0.1",
    "rpl": "1.1 1.5",
    "sgi-b": "1.0 1.1 2.0",
    "shl": "0.5 0.51",
    "spencer": "86 94 99",
    "tu-berlin": "1.0 2.0",
    "unicode": "3.0 dfs-2015 dfs-2016 tou",
    "w3c": "19980720 20150513",
    "ypl": "1.0 1.1",
    "zimbra": "1.3 1.4",
    "zpl": "1.1 2.0 2.1",
}
GNU = {"agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0"}
GNU_ENDS = ["", "-only", "-or-later"]
CC_SORTS = ["by", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-nd-nc", "by-sa"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
OTHERS = """
0bsd aal adsl aladdin antlr-pd beerware bitstream-vera bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsd-protection bsd-source-code bsl-1.0 busl-1.1
c-uda-1.0 cal-1.0 caldera catosl-1.1 cc-pddc cc0-1.0 clartistic cnri-jython cnri-python condor-1.1 cpal-1.0 cpl-1.0 cpol-1.02 cua-opl-1.0 curl d-fsl-1.0 dsdp
egenix elastic-2.0 entessa epics erlpl-1.1 etalab-2.0 eudatagrid fair frameworx-1.0 freeimage fsfap fsful fsfullr ftl gd giftware gl2ps glide glwtpl gnuplot
hippocratic-2.1 hpnd ibm-pibs icu ijg imagemagick imatix imlib2 info-zip intel interbase-1.0 ipa ipl-1.0 isc jasper-2.0 json latex2e leptonica libpng
libpng-2.0 libtiff linux-openib miros mit mitnfa motosoto mpich2 ms-pl ms-rl mtll multics nasa-1.3 naumen ncsa net-snmp netcdf ngpl nokia nosl noweb
nposl-3.0 nrl ntp o-uda-1.0 occt-pl oclc-2.0 odbl-1.0 odc-by-1.0 ogtsl openssl opl-1.0 oset-pl-2.1 pddl-1.0 plexus postgresql psf-2.0 psutils qhull qpl-1.0
rpsl-1.0 rsa-md rscpl ruby sax-pd saxpath scea sendmail simpl-2.0 sissl sleepycat smlnj smppl snia spl-1.0 sspl-1.0 sugarcrm-1.1.3 swl tapr-ohl-1.0 tcl
tcp-wrappers tmate torque-1.1 tosl ucl-1.0 unlicense upl-1.0 vim vostrom vsl-1.0 w3c watcom-1.0 wtfpl x11 xerox xfree86-1.1 xinetd xnet xpp zed zend-2.0 zlib
zlib-acknowledgement
""".split()
# Exceptions that may follow "with", in lower case.
EXCEPTIONS = frozenset("""
389-exception asterisk-exception autoconf-exception-2.0 autoconf-exception-3.0 autoconf-exception-generic bison-exception-1.24 bison-exception-2.2 bootloader-exception
classpath-exception-2.0 clisp-exception-2.0 cryptsetup-openssl-exception digirule-foss-exception ecos-exception-2.0 fawkes-runtime-exception fltk-exception
font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnat-exception gnu-javamail-exception gpl-3.0-interface-exception
gpl-3.0-linking-exception gpl-3.0-linking-source-exception gpl-cc-1.0 gstreamer-exception-2005 gstreamer-exception-2008 i2p-gpl-java-exception kicad-libraries-exception
lgpl-3.0-linking-exception libpri-openh323-exception libtool-exception linux-syscall-note llgpl llvm-exception lzma-exception mif-exception nokia-qt-exception-1.1
ocaml-lgpl-linking-exception occt-exception-1.0 openjdk-assembly-exception-1.0 openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qpl-1.0-inria-2004-exception
qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 sane-exception shl-2.0 shl-2.1 stunnel-exception swi-exception swift-exception texinfo-exception
u-boot-exception-2.0 ubdl-exception universal-foss-exception-1.0 vsftpd-openssl-exception wxwindows-exception-3.1 x11vnc-openssl-exception
""".split())
_OWN_NAME = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")


def identifiers(path: str | None = None) -> frozenset[str]:
    """The known licences, and those of a file with a name in each line."""
    known = {f"{name}-{v}" for name, versions in FAMILIES.items() for v in versions.split()} | set(OTHERS)
    known |= {f"{name}-{v}{end}" for name, versions in GNU.items() for v in versions.split() for end in GNU_ENDS}
    known |= {f"cc-{sort}-{v}" for sort in CC_SORTS for v in CC_VERSIONS}
    if path:
        with open(path) as f:
            known |= {line.strip().lower() for line in f if line.strip()}
    return frozenset(known)


KNOWN = identifiers()


def is_licence(name: str, known: frozenset[str] = KNOWN) -> bool:
    """Whether a name in lower case is a listed licence, "or later" by a plus included, or one that its document defines."""
    return name in known or name.endswith("+") and name[:-1] in known or bool(_OWN_NAME.fullmatch(name))


_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}

#: Bytes of a text as bytes of its words: A-Z lower-cased, other ASCII but digits and letters blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A byte of a word, and the first of each.
_INNER = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_STARTS = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])[0-9A-Za-z\x80-\xff]")
_LINE_END = re.compile(r"[\r\n]")

_PLACE = pa.list_(pa.struct([("label", pa.string()), ("sort", pa.string()), ("word", pa.int64())]))


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrases, sort in ((BASE_PHRASES, "base"), (OWN_PHRASES, "own")):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (len(phrase) + 1, label, sort))
    found.make_automaton()
    return found


def postfix(text: str, start: int = 0, end: int | None = None) -> list[str]:
    """The licence expression at the start of text[start:end] in postfix order, by shunting-yard; ValueError if there is none."""
    out, held, want = [], [], True
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        token = m[0].lower()
        if token == "(":
            if not want:
                break
            held.append(token)
        elif token == ")":
            if want:
                raise ValueError("operand missing")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif token in _BINDS:
            if want:
                raise ValueError("operand missing")
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            want = True
        elif not want:
            break  # what follows an expression is a comment
        else:
            out.append(token)
            want = False
    if want or "(" in held:
        raise ValueError("not a whole expression")
    return out + held[::-1]


def evaluate(order: list[str], accepted: frozenset[str] = ACCEPTED) -> tuple[bool, list[str]]:
    """Whether an expression can be met by accepted licences, and its licences; a known exception leaves its licence's value, another one can't be met."""
    stack, names = [], []
    for token in order:
        if token not in _BINDS:
            stack.append((token in accepted or token.removesuffix("+") in accepted, token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0] and right[1] in EXCEPTIONS, ""))
            names += [left[1]] if left[1] else []
            continue
        names += [x for x in (left[1], right[1]) if x]
        stack.append((left[0] and right[0] if token == "and" else left[0] or right[0], ""))
    if stack[-1][1]:
        names.append(stack[-1][1])
    return stack[-1][0], sorted(set(names))


def tag_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word(TAG, len(TAG))
    found.make_automaton()
    return found


def scanner(known: frozenset[str] = KNOWN, accepted_names: frozenset[str] = ACCEPTED):
    search, tags = automaton(), tag_automaton()

    def tagged(text: str) -> tuple[list[dict], bool | None]:
        """Licences of the tags' expressions, and whether all of them can be met (null without a whole expression)."""
        data = text.encode()
        line = data.translate(_LOWER).decode("latin-1")
        found, accepted, words, at, end = [], None, 0, 0, -1
        for last, length in tags.iter(line):
            start, begin = last + 1 - length, last + 1
            if start and _INNER.match(data, start - 1):
                continue
            if begin > end:
                m = _LINE_END.search(line, begin)
                end = m.start() if m else len(line)
            words, at = words + len(_STARTS.findall(data, at, start)), start  # goes on from the last tag
            try:
                met, names = evaluate(postfix(line, begin, end), accepted_names)
            except (ValueError, IndexError):
                continue
            accepted = met if accepted is None else accepted and met
            found += [{"label": n, "sort": "tag", "word": words} for n in names if is_licence(n, known)]
        return found, accepted

    def scan(text: str) -> tuple[int, list[dict], bool | None]:
        words = text.encode().translate(_WORDS).split()
        line = b" ".join([b"", *words, b""]).decode("latin-1")
        places, counted, at = [], 0, 0
        for end, (length, label, sort) in search.iter(line):
            places.append((end - length, label, sort))
        found = []
        for start, label, sort in sorted(places):
            counted, at = counted + line.count(" ", at, start), start
            found.append({"label": label, "sort": sort, "word": counted})
        tags_found, accepted = tagged(text) if b"spdx" in words else ([], None)
        return len(words), found + tags_found, accepted

    return scan


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: frozenset[str] = KNOWN, accepted: frozenset[str] = ACCEPTED) -> DataFrame:
    """id, n_words, places (label, sort, word) and accepted (null without a tagged expression).

    Null and empty texts have no words; repeated rows stay. Broken expressions
    give no labels, and names in an expression that are no licence neither.
    """

    def make():
        scan = scanner(known, accepted)

        def call(texts):
            n, places, met = zip(*map(scan, texts))
            return {"n_words": list(n), "places": pa.array(places, _PLACE), "accepted": pa.array(met, pa.bool_())}

        return call

    return map_texts(df, make, "n_words long, places array<struct<label string, sort string, word long>>, accepted boolean", id_col, text_col)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    base = F.filter("places", lambda p: p.sort == "base")
    words = F.transform(base, lambda p: p.word)
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")
    sorts, doubt = F.transform("places", lambda p: p.sort), F.lit(1.0)
    for sort, weight in WEIGHTS.items():
        doubt = doubt * F.when(F.array_contains(sorts, sort), 1 - weight).otherwise(1.0)
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.round(1 - doubt, 4).alias("score"),
        "accepted",
    )
