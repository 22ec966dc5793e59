"""DataFrame operators keyed by arbitrary entity and period columns.

Design rule: no ordered window and no collected list ever sees an unbounded group. Either the rows are
first reduced, by an aggregate with a map-side half, to a grain whose groups are bounded by the calendar
(entity x day, entity x month), or the order is cut into ranges of counted size (`ranking`).
"""
