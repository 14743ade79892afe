"""Where relations come from: repositories, folders, workspaces, configuration, diffs, logs."""
