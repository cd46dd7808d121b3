"""The query layer: one method for each data route, the question router, accounts, case store, audit log."""
