"""Every registered query of the library proper."""

from spanloom.plans import critique, evaluation, folded, living, more, records, releases, selection, serial, spans, text, timeline, wordlists

QUERIES, ORACLES = {}, {}
for _module in (spans, text, selection, evaluation, timeline, records, more, folded, releases, wordlists, living, critique):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
ORACLES |= serial.ORACLES
