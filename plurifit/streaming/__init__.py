"""Nothing here on purpose: the work this library covers is batch only.

There are no streams, watermarks or stateful operators to reproduce, and none
are invented.  The package exists so that the layout stays the agreed one.
"""
