import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Both folders have a conftest; whichever is imported by that name has the repository's folder.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
