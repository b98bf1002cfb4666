import sys

from tessera.cli import main

sys.exit(main(sys.argv[1:]))
