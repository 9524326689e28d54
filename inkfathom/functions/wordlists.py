"""Words, markers and constants that results depend on."""

# Words that are never key terms.
STOP_WORDS = """
about above after again against also among another around because been before being below between
both cannot could does doing down during each even every from further have having here into itself
just like many more most much must never only other ours over same should some still such than that
their them then there these they this those through under until very were what when where which while
whom will with within without would your yours you're we're it's don't can't isn't
adalah akan atau bagi bahawa banyak boleh dalam dari daripada dengan dia hanya ialah itu jika juga
kami kamu kepada kerana lagi lebih mana masih mereka oleh pada para saja sahaja sama sangat satu
sebagai sedang sejak selepas semua sini sudah supaya tetapi untuk yang ingin anda saya kita ini
follow following followers like likes comment comments share shares reply replies send save saved
view views more less show hide open close back next home search menu settings notifications message
messages chat online typing today yesterday tomorrow edit delete copy report post posts story stories
reels live video photo photos image images link links download upload cancel done okay http https
www com net org please times files volume thanks thank monday tuesday wednesday thursday friday saturday sunday january february march april
june july august september october november december
""".split()

# Given names that announce a person's name.
GIVEN_NAMES = """
Muhammad Muhamad Mohammad Mohamad Mohammed Mohd Muhd Ahmad Abdul Abd Nur Nurul Nor Noor Siti Wan Nik Tengku Tunku Syed
Sharifah Puteri Megat Raja Nurin Nurfarah Aisyah Aishah Fatimah Khairul Hafiz Hafizah Amirul Aiman Izzat Syafiq Farah
Nabila Aina Balqis
""".split()
# Forms of address.
HONORIFICS = ["Mr", "Ms", "Mrs", "Dr", "Ir", "Tun", r"Tan\s+Sri", r"Puan\s+Sri", r"Toh\s+Puan", r"Datuk\s+Seri", r"Dato'?\s+Sri", "Datuk", "Dato'?", "Datin", "Encik", "Puan", "Cik", "Tuan", "Haji", "Hajah", "Prof"]
# States.
STATES = ["Johor", "Kedah", "Kelantan", "Melaka", "Malacca", "Negeri Sembilan", "Pahang", "Perak", "Perlis", "Pulau Pinang", "Penang", "Sabah", "Sarawak", "Selangor", "Terengganu", "Kuala Lumpur", "Putrajaya", "Labuan", "Wilayah Persekutuan"]
# Street words.
STREETS = ["Jalan", "Jln", "Lorong", "Lrg", "Persiaran", "Taman", "Tmn", "Kampung", "Kg", "Blok", "Block", "Lebuh", "Presint"]
# Words that make a line no person's name, and words that follow one.
NOT_NAMES = "program programme express stack services? sdn bhd team group university universiti academy club centre center department jabatan workshop company studio labs? school college kolej official news project system systems solutions digital media global network community society foundation".split()
TITLES = ["Lecturer", "Professor", "Engineer", "Manager", "Director", "Student", "Intern", "Developer", "Analyst", "Officer", "Executive", "Founder", "CEO", "CTO", "COO", "Specialist", "Consultant", "Researcher", "Scientist", "Designer", "Head of", "Pensyarah", "Pengurus", "Pelajar"]
# Top-level domains that make a bare host a link.
LINK_TLDS = """
com net org io app dev ai co me my sg id uk us gov edu info biz ly gg xyz tv so to site online store shop link page tech
cloud live news blog in jp cn de fr au gle gl sh lk ph th vn tw kr hk nz ca eu es it nl ch at be se no dk fi pl ru br mx ar
""".split()
