"""Where changelogs come from and where state goes: tables, snapshots, state stores."""
