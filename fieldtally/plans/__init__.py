"""The work itself: survey tallies, station names, the effort matrix, sensors and
the exploring queries."""
